"""Training-data operators: dedup, scoring, packing, tokenising and web-archive jobs."""
