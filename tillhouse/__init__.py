"""Tillhouse: a retail warehouse refresh written as PySpark DataFrame jobs."""
