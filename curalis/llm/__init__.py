"""Training-data operators: quality, near-duplicates, language, packing, counting, toxicity, URLs, mixing."""
