"""Names of the dialect's types and functions."""
