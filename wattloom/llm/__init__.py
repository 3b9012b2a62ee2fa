"""Operators for training-data pipelines: dedup, decontamination, filters, tokens, extraction."""
