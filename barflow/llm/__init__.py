"""Training-data operators: deduplication, counting, packing, scoring, search, decontamination."""
