"""A Spark engine for note events, token sequences, candidate ranking and corpus preparation."""
