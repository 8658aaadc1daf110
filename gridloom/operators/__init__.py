"""Operators: DataFrame in, DataFrame out; most take an optional scope column (such as a city)."""
