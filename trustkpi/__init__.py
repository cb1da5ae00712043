"""KPI and data-trust analytics on Spark DataFrames."""
