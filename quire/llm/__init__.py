"""Operators for corpora of training documents; nothing else in the library imports this."""
