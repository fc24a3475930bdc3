"""Flight-delay analytics as functions over Spark DataFrames."""
