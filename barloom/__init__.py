"""barloom: Spark-native panel analytics (bars, factors, portfolios) on DataFrames."""
