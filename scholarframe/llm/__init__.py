"""Training-data operators: filtering, deduplication, decontamination, packing and output."""
