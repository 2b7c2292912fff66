"""Frequent keys, linear sketches, sampling and quality metrics over key streams, on Spark."""
