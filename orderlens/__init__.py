"""orderlens: shop-order analytics on Spark DataFrames.

Subpackages: ``sources`` (tables, readers, writers, stores), ``functions``
(column expressions: periods, predicates, formatting), ``plans`` (paging,
joins, nesting, sequencing, lineage), ``operators`` (the public analytics
functions) and ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
