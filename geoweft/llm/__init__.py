"""Operators that prepare text, media and vectors for training corpora."""
