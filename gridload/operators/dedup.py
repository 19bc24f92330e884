"""In-batch duplicates: keep first/last/none, analysis, uniqueness checks.

Skew: a single key may hold a large share of the rows (null or default keys).
``keep='first'/'last'`` uses ``row_number() == 1``, which Spark plans with a
partial ``WindowGroupLimit`` before the shuffle, so a hot key sends at most
one row per input partition across the network. ``keep='none'`` and the
analyses are plain aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order_cols(order_by: Sequence[str], descending: bool):
    return [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_first()
            for c in order_by]


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
          keep: str | bool = "first") -> DataFrame:
    """Drop in-batch duplicates by key; nulls in keys compare equal.

    ``order_by`` is the declared row order (``first`` = lowest). ``keep`` is
    ``'first'``, ``'last'`` or ``False``/``'none'`` (drop every duplicated key).
    """
    if not keys:
        return df
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    if keep in (False, "none"):
        # two rows of a key tell that it is duplicated: the group limit ships at most two per key and input
        # partition, and one shuffle by key serves both the limit and the count
        w = Window.partitionBy(*keys).orderBy(F.lit(0))
        two = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
        all_rows = Window.partitionBy(*keys)
        return two.withColumn("_n", F.count(F.lit(1)).over(all_rows)).filter(F.col("_n") == 1).drop("_rn", "_n")
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order_by, keep == "last"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def duplicate_groups(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """A10 per group: key values, row count, first and last row id, for keys seen more than once.

    Null-key groups are left out of the group list (as the report does);
    they still count as duplicated rows in :func:`duplicate_summary`.
    The member rows themselves are :func:`duplicate_members` (long form, no
    per-group collection).
    """
    not_null = None
    for k in keys:
        c = F.col(k).isNotNull()
        not_null = c if not_null is None else not_null & c
    return (df.filter(not_null).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("dup_count"),
                 F.min(row_id).alias("first_row"), F.max(row_id).alias("last_row"))
            .filter(F.col("dup_count") > 1))


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once (nulls equal), with the group size.

    Salted two-level count, so a hot key never sits in one task: rows get a salt (a hash of
    the row); counts per (key, salt) are summed per key; the total is attached to each
    (key, salt) pair — at most one row per salt — and the rows join back on (key, salt).
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    tagged = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts)))
    per_ks = tagged.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    per_k = (per_ks.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("dup_count"))
             .filter(F.col("dup_count") > 1)
             .select(*[F.col(k).alias("_d_" + k) for k in keys], "dup_count"))
    kcond = None
    for k in keys:
        c = per_ks[k].eqNullSafe(per_k["_d_" + k])
        kcond = c if kcond is None else kcond & c
    ks = per_ks.join(per_k, kcond).select(*[per_ks[k].alias("_d_" + k) for k in keys],
                                          per_ks["_salt"].alias("_d_salt"), "dup_count")
    cond = tagged["_salt"] == ks["_d_salt"]
    for k in keys:
        cond = cond & tagged[k].eqNullSafe(ks["_d_" + k])
    return tagged.join(ks, cond, "inner").drop("_salt", "_d_salt", *["_d_" + k for k in keys])


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10 totals: rows, rows in duplicated keys (nulls equal), unique rows, reported groups."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    not_null = None
    for k in keys:
        c = F.col(k).isNotNull()
        not_null = c if not_null is None else not_null & c
    return per_key.agg(
        F.sum("n").cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("unique_count"),
        F.count_if((F.col("n") > 1) & not_null).alias("total_groups"),
    ).withColumn("has_internal_duplicates", F.col("duplicate_count") > 0)


def full_duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column (null-safe).

    Wide rows are not shuffled whole: each row gets a 64-bit fingerprint; a row whose
    fingerprint is unique is certainly distinct, and only rows sharing a fingerprint are
    grouped exactly on all their columns (so collisions never merge different rows).
    """
    cols = df.columns
    tagged = df.withColumn("_fp", F.xxhash64(*[F.col(c) for c in cols]))
    per_fp = tagged.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    shared = per_fp.filter(F.col("_n") > 1).select("_fp")
    groups = (tagged.join(shared, "_fp", "left_semi").groupBy("_fp", *cols).agg(F.count(F.lit(1)).alias("_m"))
              .select(F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_group")))
    # fingerprint counts and exact groups in one aggregate
    both = per_fp.select("_n", F.lit(False).alias("_group")).unionByName(groups).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"),
        (F.count_if(~F.col("_group") & (F.col("_n") == 1)) + F.count_if(F.col("_group"))).alias("_distinct"))
    distinct = F.col("_distinct").cast("bigint")
    return both.select("total_rows", distinct.alias("distinct_rows"),
                       (F.col("total_rows") - distinct).cast("bigint").alias("duplicate_rows"))


def repeated_values(df: DataFrame, column: str, prefilter: bool = True) -> DataFrame:
    """Every row whose value in ``column`` occurs more than once (nulls repeat too).

    For long values (document texts) the value itself should not be shuffled for every row:
    rows are first counted by ``(xxhash64, length)`` — two longs per row, partially
    aggregated — and only rows whose fingerprint repeats go to the exact grouping on the
    value, so hash collisions cannot produce false duplicates.
    """
    if not prefilter:
        return duplicate_members(df, [column])
    fp = [F.xxhash64(F.col(column)).alias("_fp_h"), F.length(F.col(column)).alias("_fp_l")]
    tagged = df.select("*", *fp)
    rep = (tagged.groupBy("_fp_h", "_fp_l").agg(F.count(F.lit(1)).alias("_fp_n"))
           .filter(F.col("_fp_n") > 1).drop("_fp_n"))
    cond = (tagged["_fp_h"] == rep["_fp_h"]) & tagged["_fp_l"].eqNullSafe(rep["_fp_l"])
    candidates = tagged.join(rep, cond, "left_semi").drop("_fp_h", "_fp_l")
    return duplicate_members(candidates, [column])
