"""Chunk files that keep arriving."""
