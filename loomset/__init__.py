"""loomset: document-to-dataset processing on PySpark DataFrames."""
