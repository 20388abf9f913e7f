"""Document retrieval analytics, built on PySpark DataFrames."""
