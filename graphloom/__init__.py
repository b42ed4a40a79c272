"""graphloom: code-graph and change-log analytics on Spark DataFrames and streams."""
