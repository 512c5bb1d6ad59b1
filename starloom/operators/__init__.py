"""Relational building blocks over DataFrames."""
