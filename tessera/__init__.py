"""Tessera: a PySpark-native analytics engine for a bank of generated exercises."""
