"""Business operators: lazy functions from DataFrames to a DataFrame."""
