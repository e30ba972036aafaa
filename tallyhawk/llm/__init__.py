"""Training-data operators: mixing, filtering, extraction, de-duplication, formatting, packing."""
