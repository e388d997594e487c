"""Operators: DataFrames in, a DataFrame out, no actions but the size checks in ``skew``."""
