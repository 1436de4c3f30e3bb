"""Feeds, tables, vector stores and evaluation reports."""
