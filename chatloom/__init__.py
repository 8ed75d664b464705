"""Chat and tool-call corpus analytics on Spark DataFrames."""
