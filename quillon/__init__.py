"""Graph, statistics and retrieval analytics over Spark DataFrames."""
