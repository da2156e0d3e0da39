"""Readers for landed evidence and the mapping of the sample tables onto it."""
