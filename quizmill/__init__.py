"""Question-bank analytics on PySpark: DataFrame in, DataFrame out."""
