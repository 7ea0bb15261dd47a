"""Training-data operators: deduplication, scoring, mixing, sharding, tokens, extraction."""
