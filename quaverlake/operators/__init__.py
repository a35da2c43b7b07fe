"""Joins, aggregations, windows and detectors over note tables, token sequences and candidate tables."""
