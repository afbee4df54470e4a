"""Operators on relations: DataFrame to DataFrame."""
