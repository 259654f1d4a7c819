"""Analytics over collections of scientific papers, expressed in PySpark."""
