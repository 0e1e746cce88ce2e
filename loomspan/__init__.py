"""A relational and multi-dimensional query engine on PySpark."""
