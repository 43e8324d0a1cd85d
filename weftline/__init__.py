"""weftline: knowledge-graph and corpus analytics on Spark DataFrames."""
