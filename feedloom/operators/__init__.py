"""Review analytics operators: each takes and returns lazy DataFrames."""
