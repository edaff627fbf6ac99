"""Governed text-evidence analytics on Spark: segment, identify, rank, evaluate, revise and audit."""

__version__ = "0.1.0"
