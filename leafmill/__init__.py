"""Document-data engine on PySpark: DataFrame-to-DataFrame operators."""
