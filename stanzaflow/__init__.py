"""Structure-aware text counting on Spark DataFrames."""
