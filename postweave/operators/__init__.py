"""Operators: functions from DataFrame to DataFrame, or from training rows to a model."""
