"""Panel operators: every function takes and returns DataFrames."""
