"""Training-data operators: deduplication, packing, decontamination, quality, PII."""
