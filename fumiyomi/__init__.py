"""Prose diagnostics on Apache Spark: frames of lines, sentences and tokens, and rules over them."""

__version__ = "0.1.0"
