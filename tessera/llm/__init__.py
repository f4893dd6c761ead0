"""Training-data operators: cleaning, deduplication, tokenizing, archives and chat data."""
