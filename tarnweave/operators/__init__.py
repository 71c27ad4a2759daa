"""Relational operators: functions from DataFrames to a DataFrame, without actions or state of their own."""
