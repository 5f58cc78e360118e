"""Panel time series and probabilistic forecast evaluation on Spark DataFrames."""
