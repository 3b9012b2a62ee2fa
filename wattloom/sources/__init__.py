"""Readers and writers for every layer."""
