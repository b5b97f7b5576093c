"""quillon: relational operators and functions on Spark DataFrames."""
