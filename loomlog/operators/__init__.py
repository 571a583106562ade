"""Operators on operation logs: DataFrame in, DataFrame out."""
