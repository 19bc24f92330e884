"""Ingest typing: cleaning, header mapping, casts, and the two type-inference votes.

Inference runs as aggregations over an unpivoted ``(column_name, value)``
view, so a wide sheet is one scan and one shuffle of small partial counts,
never a per-column driver loop over values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


# -- P2 / P3 -------------------------------------------------------------------

def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are null in every row (one aggregate, one small row back)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c] > 0]
    return df.select(*keep)


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows that are null in every column."""
    return df.na.drop(how="all")


# -- P4 ------------------------------------------------------------------------

def clean_headers(df: DataFrame) -> DataFrame:
    """Clean every header: strip, drop ``[^\\w\\s-]``, collapse blanks; empty → ``Column_<ordinal>``."""
    return df.toDF(*[C.clean_header(c, i) for i, c in enumerate(df.columns)])


def apply_mapping(df: DataFrame, mapping: Mapping[str, Mapping], drop_unmapped: bool = False,
                  min_confidence: float = 0.5) -> DataFrame:
    """Rename source → target when a target is given and confidence > ``min_confidence``.

    Keys of ``mapping`` are cleaned the same way as the headers, so a header
    with punctuation still finds its entry. Unmapped columns keep their
    name unless ``drop_unmapped``.
    """
    df = clean_headers(df)
    renames = {}
    for src, info in mapping.items():
        key = C.clean_header(src, -1)
        target = info.get("target")
        if target and info.get("confidence", 0) > min_confidence and key in df.columns:
            renames[key] = target
    out = df.withColumnsRenamed(renames)
    if drop_unmapped:
        out = out.select(*renames.values())
    return out


# -- P5 .. P9 --------------------------------------------------------------------

def cast_columns(df: DataFrame, types: Mapping[str, str], int_mode: str = "row") -> DataFrame:
    """Cast mapped columns: ``int``/``integer``, ``float``, ``datetime``, ``boolean``; others are text.

    ``int_mode='row'`` nulls only fractional or bad values. ``'column'``
    keeps the whole column unchanged as soon as one value is fractional
    (decided by one aggregate over the column).
    """
    exprs = {}
    col_mode = [c for c, t in types.items() if t in ("int", "integer") and int_mode == "column"]
    frac = {}
    if col_mode:
        row = df.agg(*[C.any_fractional(c).alias(c) for c in col_mode]).first()
        frac = {c: bool(row[c]) for c in col_mode}
    for c in df.columns:
        t = types.get(c)
        if t in ("int", "integer"):
            exprs[c] = F.col(c) if frac.get(c) else C.to_integer(c)
        elif t == "float":
            exprs[c] = C.to_double(c)
        elif t == "datetime":
            exprs[c] = C.to_timestamp_multi(c)
        elif t == "boolean":
            exprs[c] = C.to_boolean(c)
        elif t is not None or c in types:
            exprs[c] = C.normalize_text(c)
    return df.withColumns(exprs) if exprs else df


# -- A7: type vote ---------------------------------------------------------------

VOTE_TYPES = ["INTEGER", "DECIMAL", "DATE", "DATETIME", "BOOLEAN", "STRING"]


def _vote_class(v):
    lv = F.lower(v)
    nocomma = F.replace(v, F.lit(","), F.lit(""))
    is_date = v.rlike(K.VOTE_DATE_PATTERNS[0]) | v.rlike(K.VOTE_DATE_PATTERNS[1])
    is_dec = nocomma.rlike(K.VOTE_DECIMAL_PATTERNS[0]) | v.rlike(K.VOTE_DECIMAL_PATTERNS[1])
    return (F.when(lv.isin(*(K.BOOL_TRUE_WORDS + K.BOOL_FALSE_WORDS)), "BOOLEAN")
            .when(is_date, "DATE")
            .when(v.rlike(K.VOTE_DATETIME_PATTERN), "DATETIME")
            .when(nocomma.rlike(K.VOTE_INTEGER_PATTERN), "INTEGER")
            .when(is_dec, "DECIMAL")
            .otherwise("STRING"))


def _unpivot_text(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    cols = list(columns)
    cast = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return cast.unpivot(list(ids), cols, "column_name", "value")


def type_vote(df: DataFrame, columns: Sequence[str] | None = None,
              threshold: float = K.VOTE_THRESHOLD) -> DataFrame:
    """Per column, classify every non-null value and let a type with share ≥ threshold win.

    Ties go to the first type in INTEGER, DECIMAL, DATE, DATETIME, BOOLEAN,
    STRING order; an all-null column is STRING.
    """
    cols = list(columns or df.columns)
    long = _unpivot_text(df, cols).withColumn("_v", C.strip("value"))  # stripped once, then tested
    cls = F.when(F.col("value").isNotNull(), _vote_class(F.col("_v")))
    counts = long.select("column_name", cls.alias("cls")).groupBy("column_name").agg(
        F.count("cls").alias("n_values"),
        *[F.count_if(F.col("cls") == t).alias(f"n_{t.lower()}") for t in VOTE_TYPES])
    best = F.greatest(*[F.col(f"n_{t.lower()}") for t in VOTE_TYPES])
    pick = None
    for t in VOTE_TYPES:
        cond = F.col(f"n_{t.lower()}") == best
        pick = F.when(cond, F.lit(t)) if pick is None else pick.when(cond, F.lit(t))
    share_ok = (F.col("n_values") > 0) & (best >= F.lit(threshold) * F.col("n_values"))
    return counts.withColumn("detected_type", F.when(share_ok, pick).otherwise(F.lit("STRING")))


# -- A8: semantic kind -----------------------------------------------------------

KIND_ORDER = ["email", "phone", "numeric", "date", "boolean"]


def _kind_class(v):
    return (F.when(v.rlike(K.EMAIL_PATTERN), "email")
            .when(v.rlike(K.PHONE_PATTERN), "phone")
            .when(v.rlike(K.NUMERIC_PATTERN), "numeric")
            .when(v.rlike(K.DATE_PATTERN), "date")
            .when(v.isin(*(K.BOOL_TRUE_WORDS + K.BOOL_FALSE_WORDS)), "boolean"))


def semantic_kind(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
                  sample_rows: int | None = None,
                  threshold: float = K.KIND_THRESHOLD) -> DataFrame:
    """Kind of each column from all its non-null values, or with ``sample_rows`` from the first ones
    (declared order; the source's own sample is ``KIND_SAMPLE_ROWS``).

    The first kind in email, phone, numeric, date, boolean order whose share
    reaches the threshold wins, else ``string``; no values → ``unknown``.
    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so each column ships at most n rows per input partition.
    """
    cols = [c for c in (columns or df.columns)]
    ids = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    base = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    long = base.unpivot([f"_o{i}" for i in range(len(order_by))], cols, "column_name", "value") \
        .filter(F.col("value").isNotNull())
    if sample_rows:
        w = Window.partitionBy("column_name").orderBy(*[f"_o{i}" for i in range(len(order_by))])
        long = long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample_rows)
    kind = _kind_class(F.col("_v"))
    counts = long.withColumn("_v", F.lower(C.strip("value"))).select("column_name", kind.alias("kind")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_sampled"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KIND_ORDER])
    pick = None
    for k in KIND_ORDER:
        cond = F.col(f"n_{k}") >= F.lit(threshold) * F.col("n_sampled")
        pick = F.when(cond, F.lit(k)) if pick is None else pick.when(cond, F.lit(k))
    out = counts.withColumn("inferred_kind", pick.otherwise(F.lit("string")))
    # columns without any non-null value
    all_cols = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return all_cols.join(out, "column_name", "left").select(
        "column_name",
        F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"),
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KIND_ORDER],
        F.coalesce("inferred_kind", F.lit("unknown")).alias("inferred_kind"))
