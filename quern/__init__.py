"""quern: catalog analytics and batch recommendation on Spark DataFrames."""
