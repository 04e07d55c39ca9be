"""Training-data operators: formatting, scoring, counting, packing, search and de-duplication of text corpora."""
