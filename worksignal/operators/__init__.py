"""Relational operators: DataFrames in, DataFrame out, no actions inside."""
