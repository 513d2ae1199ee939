"""Job-market analytics as PySpark DataFrame functions."""
