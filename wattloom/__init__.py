"""Spark-native load-profile engine: meter readings in, one wide feature row per building out."""

__version__ = "0.1.0"
