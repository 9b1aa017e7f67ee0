"""Training-data operators: filtering, deduplication, mixing, packing and token storage."""
