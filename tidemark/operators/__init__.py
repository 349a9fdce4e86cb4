"""Operators: functions from DataFrames to DataFrames. Importing the package registers its plugins."""

from tidemark.operators import risk, simulate  # noqa: F401
