"""meshwork: a property-graph analytics engine on PySpark DataFrames."""
