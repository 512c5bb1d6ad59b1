"""starloom: a Spark-native dimensional-analytics engine.

Layers (all plain DataFrame -> DataFrame functions):

* ``sources``   – typed staging scans, test-table loading, versioned publish.
* ``functions`` – column-level helpers (cleaning, dates, scores).
* ``operators`` – relational building blocks (filters, joins, aggregates,
  windows, set operations, surrogate keys, data-quality checks).
* ``plans``     – the warehouse: core load, dimensions, SCD2, fact load,
  rule-checked change batches, analytics, scaling.
* ``streaming`` – Structured Streaming feeds that reuse the batch plans.
"""

__version__ = "0.1.0"
