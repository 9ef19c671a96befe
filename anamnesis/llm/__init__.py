"""Training-data operators: counting, mixing, scanning, filtering, sharding, formatting, deduplication."""
