"""Training-data operators: deduplication, filtering, packing, archives, tokens."""
