"""Training-data operators: deduplication, language, leaks, personal data, mixing, toxicity, pages."""
