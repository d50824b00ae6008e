"""Training-data operators: filtering, deduplication, scanning and packing of text corpora."""
