"""Operators that prepare text and vectors for training; nothing else in the package imports them."""
