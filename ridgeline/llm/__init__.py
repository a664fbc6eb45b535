"""Training-data operators: decontamination, PII, dedup, quality, secrets, WARC, mixing, fingerprints, language."""
