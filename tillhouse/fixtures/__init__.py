"""The raw exports derived from the generated test tables, in Spark and in SQL."""
