"""Operators: functions from DataFrames, with column names as parameters, to DataFrames."""
