"""Code-intelligence and text analytics on PySpark."""
