"""Training-data operators: quality, deduplication, archives, tokens, mixing, neighbours."""
