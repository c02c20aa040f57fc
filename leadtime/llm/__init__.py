"""Training-data operators: deduplication, scoring, filtering and mixing of document tables."""
