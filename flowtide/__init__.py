"""Order-flow toxicity analytics on Spark DataFrames."""
