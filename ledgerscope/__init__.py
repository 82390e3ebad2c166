"""Customer-transaction analytics on PySpark."""
