"""Catalogue-data analytics on Spark: DataFrame to DataFrame operators."""
