"""Training-data operators: deduplication, scoring, search, tokenising and mixing at corpus scale."""
