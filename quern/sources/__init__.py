"""Tables: registered by scripts, or read from a data folder."""
