"""Structural comparison of two snapshots of a corpus, expressed as Spark plans."""

__version__ = "0.1.0"
