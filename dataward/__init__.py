"""dataward: data quality and governance on Spark DataFrames."""
