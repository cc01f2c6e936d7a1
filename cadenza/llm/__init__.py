"""Training-data operators: archives, deduplication, decontamination, scoring, mixing and sharding."""
