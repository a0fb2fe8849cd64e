"""Jobs: DataFrames in, a DataFrame out, the clock always a parameter."""
