"""Operators on DataFrames: batch outcomes, output names, releases."""
