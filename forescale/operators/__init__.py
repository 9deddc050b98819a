"""Table operators: DataFrames and parameters in, DataFrames out."""
