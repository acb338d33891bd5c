"""Training-data operators: deduplication, retrieval, tokenising, scoring, formatting and sharding of text corpora."""
