"""Corpus operators for training data: dedup, filters, classifiers, tokens, packing and mixing."""
