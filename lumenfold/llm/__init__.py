"""Operators for large text corpora that become training data; nothing else in the library imports them."""
