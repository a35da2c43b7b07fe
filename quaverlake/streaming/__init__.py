"""Streaming twins of stateful operators; each equals its batch form on the same rows."""
