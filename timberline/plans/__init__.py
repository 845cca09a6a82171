"""Reports: named DataFrames built from the operators."""
