"""Parquet table scans (S1) and parameterised SQL over them.

Only the columns a query selects are read and filters reach the Parquet
reader (``PushedFilters``), because every scan is a plain ``spark.read``
that Catalyst can prune.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the tables as temp views for ``spark.sql``."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def sql_query(spark: SparkSession, sf_dir: str, query: str, args: dict | None = None,
              tables=None) -> DataFrame:
    """Parameterised SQL (named ``:markers``) over the tables."""
    register_views(spark, sf_dir, tables)
    return spark.sql(query, args=args or {})
