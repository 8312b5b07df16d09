"""tandemlab: paired-experiment analytics and data preparation on Spark DataFrames."""
