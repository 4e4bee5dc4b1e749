"""A metadata analytics engine on PySpark."""
