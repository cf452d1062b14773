"""Labelwright: screening of declared ingredient lists against category-dependent permissions, on Spark."""
