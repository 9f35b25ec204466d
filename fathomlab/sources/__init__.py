"""Readers, writers and generators of bars, and the views over the test tables."""
