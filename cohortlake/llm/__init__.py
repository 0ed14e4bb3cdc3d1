"""Training-data operators: text filtering, near-duplicates, search, formatting and packing."""
