"""Training-data operators: deduplication, decontamination, scoring and mixing of documents."""
