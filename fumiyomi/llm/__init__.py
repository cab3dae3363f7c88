"""Training-data operators: ten ways to judge, deduplicate, tokenize and pack large text collections."""
