"""Analytics for tables of labelled text, built on Spark DataFrames and Spark ML."""
