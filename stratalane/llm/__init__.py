"""Training-data operators: licence scan, near-dedup, search, tokenising, PII, quality."""
