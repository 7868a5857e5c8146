"""Training-data operators: mixing, scoring, encoding, extraction, screening and deduplication."""
