"""Analytics over recorded-lecture pipelines as Spark DataFrames."""
