"""Property-graph analytics over fact tables, on Spark DataFrames."""
