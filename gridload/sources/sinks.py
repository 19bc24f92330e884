"""Sinks: partitioned append of the audit log (S7), append with quarantine (S5),
insert-if-absent written as a new table version (S6).

Plain Parquet tables have no MERGE, so an upsert writes the merged result to a new path
under the shared folder and returns it; readers switch to the new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import incremental as I
from ..session import scratch_path


#: Parts into which the rows of one folder are dealt before a partitioned write.
WRITERS = 16


def write_range_partitioned(df: DataFrame, ts_col: str, path: str,
                            boundaries: Sequence[str] = tuple(K.AUDIT_MONTH_BOUNDARIES),
                            part_col: str = "partition_no", mode: str = "append") -> None:
    """Append rows partitioned by RANGE RIGHT number of ``ts_col`` (1 + boundaries ≤ ts).

    Readers filtering on ``partition_no`` (or deriving it from a date range) only list the
    matching folders (partition pruning). Rows are clustered by partition and ``WRITERS`` hash parts of it,
    so a folder has few files and a month with most of the rows still has several writers.
    """
    out = df.withColumn(part_col, C.range_right_partition(ts_col, boundaries))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(WRITERS))
    out.repartition(part_col, spread).write.mode(mode).partitionBy(part_col).parquet(path)


def append_with_quarantine(valid: DataFrame, rejects: DataFrame, target_path: str,
                           quarantine_path: str) -> None:
    """Valid rows and rejected rows (with their reason) appended to their own tables."""
    valid.write.mode("append").parquet(target_path)
    rejects.write.mode("append").parquet(quarantine_path)


def insert_if_absent_version(target: DataFrame, incoming: DataFrame, keys: Sequence[str],
                             name: str = "table", path: str | None = None) -> str:
    """Write target ∪ (incoming rows whose key is absent) as a new version at ``path`` (by default a
    scratch folder); return its path."""
    path = path or scratch_path(target.sparkSession, f"{name}-v")
    I.insert_if_absent(target, incoming, keys).write.mode("overwrite").parquet(path)
    return path


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """A table as one folder per key bucket. ``buckets`` should make a bucket one task's work."""
    df.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_buckets(incoming: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """S6/C2 as a table update: rows of ``incoming`` replace the table's rows of equal keys (null equals null) or are added.

    Only the buckets that ``incoming`` touches are read and rewritten; the files of all others stay. Keys must be unique in
    ``incoming`` (a repeat raises before anything is written). The merged buckets are staged in the shared folder before the
    overwrite, and running the same upsert again gives the same table. Back to the driver come at most ``buckets`` numbers.
    """
    spark = incoming.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    rows = staged(incoming.withColumn("bucket", _bucket(keys, buckets)), "upsert-rows")
    if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys {list(keys)} in the incoming rows")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    merged = staged(I.filter_new(old, rows, keys).select(rows.columns).unionByName(rows), "upsert-merged")
    (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
     .parquet(path))


def partition_of(ts: str, boundaries: Sequence[str] = tuple(K.AUDIT_MONTH_BOUNDARIES)) -> int:
    """Driver-side partition number of one timestamp literal, for pruning filters."""
    return 1 + sum(1 for b in boundaries if ts >= b)

