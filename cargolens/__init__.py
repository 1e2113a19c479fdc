"""Static audit of machine-learning model artifacts at fleet scale, on Spark DataFrames."""
