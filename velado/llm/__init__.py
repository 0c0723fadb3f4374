"""Training-data operators on text corpora. Nothing outside this folder imports it."""
