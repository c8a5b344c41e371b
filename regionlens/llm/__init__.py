"""Training-data operators: archive, deduplication, filtering, tokens, shards."""
