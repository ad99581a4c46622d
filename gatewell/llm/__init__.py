"""Training-data operators: language, quality, contamination, duplicates, secrets, tokens, web archives."""
