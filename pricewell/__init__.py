"""Price-index analytics as PySpark DataFrame operators."""
