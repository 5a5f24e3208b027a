"""Operators of a training-data pipeline: mixing, quality, media, chat, sharding, de-duplication, tokens, toxicity."""
