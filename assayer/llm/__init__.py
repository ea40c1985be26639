"""Training-data pipeline operators: packing, sharding, scanning, extraction, quality, decontamination, deduplication, toxicity."""
