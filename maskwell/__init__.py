"""Privacy-preserving analytics on PySpark."""
