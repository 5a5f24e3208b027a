"""A catalog curation engine on Spark: land, normalise, resolve, serve, match and check a catalog of dated items."""
