"""Operators of the engine: DataFrame in, DataFrame out."""
