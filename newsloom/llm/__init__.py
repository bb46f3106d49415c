"""Training-data operators: packing, deduplication, mixing, scans, counts, search and classification."""
