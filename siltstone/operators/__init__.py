"""Relational, ordered and graph operators: functions from DataFrames to DataFrames."""
