"""Operators: functions from DataFrames to a DataFrame, keyed by station and time."""
