"""Data operators over DataFrames."""
