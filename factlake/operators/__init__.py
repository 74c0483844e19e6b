"""The operators over a graph; each takes DataFrames and returns DataFrames, many subjects at a time."""
