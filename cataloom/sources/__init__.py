"""Landed inputs (JSON, HTML pages, texts) and file sinks. Live HTTP stays outside: connectors land files, the engine reads them."""
