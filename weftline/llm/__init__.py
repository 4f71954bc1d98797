"""Training-data operators: licence scans, language ID, quality, mixing, rules, dedup, secrets, packing, token stores, search."""
