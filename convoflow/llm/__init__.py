"""Training-data operators: mixing, de-duplication, search, tokens, quality, secrets, toxicity, packing, scoring."""
