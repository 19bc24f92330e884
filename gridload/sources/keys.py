"""Key discovery (S11) and referential checks.

Spark enforces no keys, so declared candidates (primary key, unique
constraints, unique indexes, by priority 1/2/3) are verified on the data:
a candidate is unique when no key tuple repeats (nulls compare equal).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIORITY = {"PRIMARY KEY": 1, "UNIQUE": 2, "UNIQUE INDEX": 3}


def verify_candidates(df: DataFrame, candidates: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """Per candidate ``(name, kind, columns)``: rows, distinct key tuples, uniqueness and priority.

    All candidates are grouping sets of one aggregate: one scan and one shuffle, exact, and a hot key tuple is absorbed
    by the partial aggregate. An empty table has no rows to tell: uniqueness is null.
    """
    cols = list(dict.fromkeys(c for _, _, key in candidates for c in key))
    number = lambda key: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in key)
    sets = {number(key): list(dict.fromkeys(key)) for _, _, key in candidates}
    per_key = df.groupingSets([[df[c] for c in key] for key in sets.values()], *[df[c] for c in cols]).agg(
        F.grouping_id().cast("bigint").alias("_set"), F.count(F.lit(1)).alias("_n"))
    per_set = per_key.groupBy("_set").agg(F.sum("_n").cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame(
        [(name, kind, ",".join(key), PRIORITY.get(kind, 9), number(key)) for name, kind, key in candidates],
        "key_name string, key_type string, key_columns string, priority int, _set bigint")
    return names.join(per_set, "_set", "left").select(
        "key_name", "key_type", "key_columns", "priority", "n_rows", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        (F.col("n_rows") == F.col("n_distinct")).alias("is_unique"))


def best_key_columns(df: DataFrame, candidates: Sequence[tuple[str, str, Sequence[str]]]) -> list[str] | None:
    """The columns of the best verified key: candidates are checked in priority order (declared
    order on ties) and the first unique one wins, so lower-priority keys are never scanned
    once a better one holds. One small row per check comes back to the driver."""
    order = sorted(range(len(candidates)), key=lambda i: (PRIORITY.get(candidates[i][1], 9), i))
    for i in order:
        row = verify_candidates(df, [candidates[i]]).first()
        if row["is_unique"]:
            return list(candidates[i][2])
    return None
