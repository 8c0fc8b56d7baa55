"""Graph-pattern analytics over typed triple tables, expressed as Spark DataFrames."""
