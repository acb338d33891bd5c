"""Larder: retail-promotion analytics as PySpark DataFrame operators."""
