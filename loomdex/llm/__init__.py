"""Operators that prepare a corpus for training language models. Nothing outside this package imports it."""
