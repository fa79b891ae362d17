"""graphloom: a property-graph query engine over PySpark DataFrames."""
