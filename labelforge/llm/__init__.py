"""Training-data operators: cleaning, de-duplication, decontamination, packing and scoring of text corpora."""
