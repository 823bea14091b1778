"""A query engine, an equivalence checker and training-data operators on Spark."""
