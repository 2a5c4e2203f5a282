"""Set-oriented operational data-quality checks on Spark DataFrames."""
