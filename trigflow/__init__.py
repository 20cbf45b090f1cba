"""Event-triggered analytics operators on Spark DataFrames."""
