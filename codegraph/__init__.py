"""Code-knowledge-graph analytics on PySpark DataFrames."""
