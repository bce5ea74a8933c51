"""Training-data operators: packing, dedup, scoring, filters, search, extraction, sharding."""
