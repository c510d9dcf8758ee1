"""Orrery: analytics over code knowledge graphs, written as Spark DataFrame plans."""

__version__ = "0.1.0"
