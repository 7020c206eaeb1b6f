"""Evaluation statistics and training-data operators on PySpark."""
