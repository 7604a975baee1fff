"""Training-data operators: quality, language, personal data, near copies, packing, scoring."""
