"""tierline: supply-graph analytics and data preparation on Spark DataFrames."""
