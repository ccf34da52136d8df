"""SupportLens: analytics over customer-support conversations, built on Spark DataFrames."""
