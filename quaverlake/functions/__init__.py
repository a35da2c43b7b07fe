"""Scalar functions on pitches, keys, meters and arrays, as Spark columns."""
