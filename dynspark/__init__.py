"""Global dynamics of discrete-time maps as Spark DataFrames."""
