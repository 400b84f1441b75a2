"""Training-data operators: dedup, scoring, decontamination, mixing, sharding, search and language ID."""
