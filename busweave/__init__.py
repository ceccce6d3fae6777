"""Public-transit analytics as PySpark DataFrame functions."""
