"""A clinical-query engine on Spark: expressions and query definitions become Column and DataFrame plans."""
