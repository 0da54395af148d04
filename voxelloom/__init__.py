"""Surface mapping and inspection analytics on Spark DataFrames."""
