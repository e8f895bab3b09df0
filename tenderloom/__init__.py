"""Procurement analytics on Spark: notices in, calendar cubes and look-ups out."""

__version__ = "0.1.0"
