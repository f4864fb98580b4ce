"""Training-data operators: deduplication, tokens, packing, archives, filters and classifiers."""
