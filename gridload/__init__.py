"""gridload: sheet-to-warehouse loading, validation, deduplication, change capture,
reconciliation and fuzzy linkage as Spark DataFrame functions.

Subpackages: ``functions`` (Column builders, fixed values), ``sources`` (scans, exports,
keys, sinks), ``operators`` (the data work), ``plans`` (fixtures, registered queries,
pipelines), ``streaming`` (Structured Streaming and stateful operators).
"""

__version__ = "0.1.0"
