"""Training-data operators: dedup, filters, tokens, models and media over text corpora."""
