"""airfill: air-quality gap filling as Spark DataFrame operators.

Subpackages
-----------
sources    fixture views, readers and table sinks (scan, upsert, resume)
functions  scalar Column expressions (geodesy, time, text, display)
operators  relational building blocks (as-of join, spatial nearest, folds, metrics, model)
plans      composite queries built from the operators (labels, features, field, ...)
streaming  Structured Streaming forms of cleaning, latest state and self-scoring
"""

__version__ = "0.1.0"
