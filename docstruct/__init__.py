"""docstruct: structured analysis of large document collections with PySpark."""
