"""Training-data operators: sharding, language, privacy, quality, duplicates, leaks, secrets, toxicity, packing, pages."""
