"""Training-data operators: dedup, mixing, sharding, packing, scoring, scans."""
