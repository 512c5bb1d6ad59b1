"""Warehouse plans built from the operators."""
