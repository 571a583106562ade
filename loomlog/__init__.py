"""Operation-log analytics on PySpark."""
