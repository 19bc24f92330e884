"""Operators of a training-data pipeline, each re-expressed as Spark jobs.

Nothing else in the package imports this subpackage; its queries are in
``gridload.llm.catalog``.
"""
