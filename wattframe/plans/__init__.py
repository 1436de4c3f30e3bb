"""Whole flows, and the queries registered over the given tables."""
