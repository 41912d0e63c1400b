"""Point-cloud analytics on PySpark DataFrames."""
