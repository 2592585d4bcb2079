"""Training-data operators: sharding, scoring, deduplication, archives, tokens and mixing."""
