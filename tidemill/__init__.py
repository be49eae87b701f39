"""Composition-based screening of sequence collections on PySpark."""
