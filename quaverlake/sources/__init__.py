"""Readers and writers of scores and token sequences."""
