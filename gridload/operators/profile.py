"""Column profiles and value checks (A2-A6), with exact distributed quantiles.

Profiles unpivot to ``(column_name, value)`` and aggregate twice (per value,
then per column), so distinct counts of many columns never expand rows per
column, and a frequent value collapses in the map-side partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from . import typing_ops as TY


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                   strict_null_error: bool = False) -> DataFrame:
    """A2: rows, nulls, distinct non-null values, null share and the >50 % warning per column.

    ``approx=True`` counts distinct values with HyperLogLog++ in a single aggregate.
    ``strict_null_error=True`` adds the > 80 % ``null_error`` flag; the loader's own branch for
    it can never fire (it is checked after the > 50 % warning), so it is off by default.
    """
    out = _column_profile(df, columns, approx)
    if strict_null_error:
        out = out.withColumn("null_error", F.col("null_pct") > K.NULL_ERROR_PCT)
    return out


def column_report(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A2 whole: the profile with each column's data type and inferred kind (A8, ``unknown`` without values)."""
    cols = list(columns or df.columns)
    types = dict(df.dtypes)
    named = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    kinds = TY.semantic_kind(df, order_by, cols).select("column_name", "inferred_kind")
    return column_profile(df, cols).withColumn("data_type", named[F.col("column_name")]).join(kinds, "column_name", "left")


def _column_profile(df: DataFrame, columns: Sequence[str] | None, approx: bool) -> DataFrame:
    cols = list(columns or df.columns)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "column_name", "value")
    if approx:
        prof = long.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count("value")).alias("null_count"),
            F.approx_count_distinct("value").alias("distinct_count"))
        pct = F.round(F.col("null_count") * 100.0 / F.col("n_rows"), 4)
        return prof.withColumn("null_pct", pct).withColumn("null_warning", F.col("null_pct") > K.NULL_WARN_PCT)
    per_value = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    prof = per_value.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint")
        .alias("null_count"),
        F.count("value").alias("distinct_count"))
    pct = F.round(F.col("null_count") * 100.0 / F.col("n_rows"), 4)
    return prof.withColumn("null_pct", pct).withColumn("null_warning", F.col("null_pct") > K.NULL_WARN_PCT)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], buckets: int | None = None,
                    values_per_bucket: int = 1_000_000) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/``quantile_cont`` semantics), distributed.

    1. distinct values with their counts (a hot value becomes one row);
    2. the distinct values are cut into ranges by approximate quantiles, so each range holds a
       similar number of distinct values; the number of ranges grows with the data (about
       ``values_per_bucket`` rows per range);
    3. per-range totals (one row per range) tell which ranges hold the 2·len(probs) needed ranks;
    4. only those ranges are sorted, and the ranks joined to them by range.
    No task holds more than one range of distinct values. Runs eagerly (the distinct values are
    cached across the two passes) and returns the ``len(probs)`` results as a small DataFrame.
    """
    from pyspark.ml.feature import Bucketizer

    from pyspark import StorageLevel

    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    # distinct values are read twice (bounds, then ranks): keep them once; a lost block is
    # recomputed from lineage
    vals = x.groupBy("x").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    if buckets is None:
        # the row count bounds the distinct count from above (extra buckets stay empty);
        # on Parquet it is answered from file metadata
        rows = df.count()
        buckets = int(max(64, -(-rows // values_per_bucket)))
    cuts = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 10 * buckets)
    bounds = vals.agg(F.percentile_approx("x", cuts, accuracy).alias("b")).first()["b"] or []
    splits = [float("-inf")] + sorted(set(bounds)) + [float("inf")]
    # JVM-side binary search over the range bounds
    vals = Bucketizer(splits=splits, inputCol="x", outputCol="bucket").transform(vals)
    totals = vals.groupBy("bucket").agg(F.sum("c").alias("bc"))
    # offsets: one row per range
    totals = totals.withColumn("offset", F.coalesce(F.sum("bc").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("n", F.sum("bc").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the totals tell which ranges hold the 2·len(probs) wanted ranks; only those are sorted
    wanted = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs]))) \
        .withColumn("h", (F.col("n") - 1) * F.col("prob")) \
        .withColumn("rank", F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.floor("h").alias("r")),
                                              F.struct(F.lit(True).alias("upper"), F.ceil("h").alias("r"))))) \
        .filter((F.col("rank.r") >= F.col("offset")) & (F.col("rank.r") < F.col("offset") + F.col("bc"))) \
        .select("bucket", "offset", "prob", "h", "rank.upper", "rank.r", F.floor("h").alias("lo"))
    ranks = df.sparkSession.createDataFrame(wanted.collect(), wanted.schema)  # 2·len(probs) rows
    needed = vals.filter(F.col("bucket").isin([r["bucket"] for r in ranks.select("bucket").distinct().collect()]))
    w = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    in_range = needed.withColumn("end", F.sum("c").over(w))
    end = F.col("offset") + F.col("end")
    picked = in_range.join(F.broadcast(ranks), "bucket").filter((F.col("r") < end) & (F.col("r") >= end - F.col("c")))
    v_lo = F.max(F.when(~F.col("upper"), F.col("x")))
    v_hi = F.max(F.when(F.col("upper"), F.col("x")))
    result = picked.groupBy("prob").agg(
        (v_lo + (F.max("h") - F.max("lo")) * (v_hi - v_lo)).alias("value")).collect()  # len(probs) rows
    vals.unpersist()
    return df.sparkSession.createDataFrame([(r["prob"], r["value"]) for r in result],
                                           "prob double, value double")


def numeric_profile(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """A3: min, max, mean, sample std, Q1/Q3 (exact, interpolated), IQR bounds, outlier count.

    The two quartiles are computed once (distributed, see :func:`exact_quantiles`) and come
    back as two numbers; the statistics and the outlier count then share one scan.
    ``approx=True`` takes the quartiles from ``percentile_approx`` (one pass, no interpolation).
    """
    x = df.select(C.to_double(column).alias("x"))
    if approx:
        row = x.agg(F.percentile_approx("x", list(K.QUARTILES), 10_000).alias("q")).first()["q"] or [None, None]
        q = dict(zip(K.QUARTILES, row))
    else:
        q = {r["prob"]: r["value"] for r in exact_quantiles(x, "x", list(K.QUARTILES)).collect()}
    q1, q3 = q.get(K.QUARTILES[0]), q.get(K.QUARTILES[1])
    if q1 is None:
        lo = hi = F.lit(None).cast("double")
    else:
        iqr = q3 - q1
        lo, hi = F.lit(q1 - K.IQR_FACTOR * iqr), F.lit(q3 + K.IQR_FACTOR * iqr)
    out = x.agg(F.min("x").alias("min_value"), F.max("x").alias("max_value"),
                F.avg("x").alias("mean_value"), F.stddev_samp("x").alias("std_value"),
                F.count("x").alias("n_values"),
                F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("outliers"))
    qv = [F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
          (F.lit(q3).cast("double") - F.lit(q1).cast("double")).alias("iqr"),
          lo.cast("double").alias("lower_bound"), hi.cast("double").alias("upper_bound")]
    out = out.select("*", *qv)
    return out.select(
        F.lit(column).alias("column_name"), "n_values",
        *[F.round(c, 6).alias(c) for c in ["min_value", "max_value", "mean_value", "std_value",
                                           "q1", "q3", "iqr", "lower_bound", "upper_bound"]],
        "outliers")


def value_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, valid/invalid email, phone and date counts over non-null values,
    and the >10 % invalid-email warning."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], list(columns), "column_name", "value").filter(F.col("value").isNotNull())
    v = F.col("value")
    email_ok = F.trim(v).rlike(K.EMAIL_PATTERN)
    phone_ok = C.phone_digits(v).rlike(K.PHONE_PATTERN)
    date_ok = C.to_timestamp_multi(v).isNotNull()
    out = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(email_ok).alias("valid_emails"), F.count_if(~email_ok).alias("invalid_emails"),
        F.count_if(phone_ok).alias("valid_phones"), F.count_if(~phone_ok).alias("invalid_phones"),
        F.count_if(date_ok).alias("valid_dates"), F.count_if(~date_ok).alias("invalid_dates"))
    return out.withColumn("email_warning", F.col("invalid_emails") > K.EMAIL_WARN_RATE * F.col("n_values"))
