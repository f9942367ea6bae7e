"""Training-data operators: fingerprints, licences, scoring, deduplication, mixing, search, packing."""
