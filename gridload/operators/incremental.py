"""Incremental load against a target: new-record filter, existence flag, stats.

The reference checks every incoming row with its own COUNT query. Here the
whole batch is one anti/semi join on null-safe keys; Catalyst turns ``<=>``
into sort-merge / hash join keys, so the plan shuffles each side once on the
key (or broadcasts the target keys when AQE measures them small).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _check_keys(df: DataFrame, keys: Sequence[str], what: str) -> None:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key columns missing from {what}: {missing}")


def _key(df: DataFrame, name: str, collation: str | None) -> Column:
    """A key column, compared under ``collation`` when given and the column is text."""
    c = df[name]
    if collation and dict(df.dtypes)[name] == "string":
        return F.collate(c, collation)
    return c


def _null_safe_cond(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    right_keys: Sequence[str] | None = None, collation: str | None = None) -> Column:
    right_keys = list(right_keys or keys)
    cond = None
    for lk, rk in zip(keys, right_keys):
        c = _key(left, lk, collation).eqNullSafe(_key(right, rk, collation))
        cond = c if cond is None else cond & c
    return cond


def target_keys(target: DataFrame, keys: Sequence[str], alias_prefix: str = "_t_",
                collation: str | None = None) -> DataFrame:
    """Distinct key tuples of the target, renamed so they never clash with the batch."""
    return target.select(*[_key(target, k, collation).alias(alias_prefix + k) for k in keys]).distinct()


#: Parts over which rows with a null key component are spread; the target's tuples with a null are copied to each.
NULL_PARTS = 32


def _any_null(df: DataFrame, cols: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in cols:
        hit = hit | df[c].isNull()
    return hit


def _salted_join(incoming: DataFrame, target: DataFrame, keys: Sequence[str], tkeys: Sequence[str],
                 collation: str | None, join) -> DataFrame:
    """Null-safe key join ``join(rows, target keys, condition)``, one scan of each side.

    A row whose key has no null has salt 0. Rows with a null component can only match target tuples with a null: they
    are spread over ``NULL_PARTS`` salts by a hash of the row, and only those (distinct) tuples are copied to each
    salt, so a null key that holds a large share of the batch isn't one task.
    """
    tcols = ["_t_" + k for k in tkeys]
    parts = F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))
    t = target_keys(target, tkeys, collation=collation)
    t = t.withColumn("_t_salt", F.explode(F.when(_any_null(t, tcols), parts).otherwise(F.array(F.lit(0)))))
    row = F.pmod(F.xxhash64(*[incoming[c] for c in incoming.columns]), F.lit(NULL_PARTS)).cast("int")
    rows = incoming.withColumn("_salt", F.when(_any_null(incoming, keys), row).otherwise(F.lit(0)))
    return join(rows, t, _null_safe_cond(rows, t, keys, tcols, collation) & (rows["_salt"] == t["_t_salt"]))


def filter_new(incoming: DataFrame, target: DataFrame, keys: Sequence[str] | None,
               target_key_names: Sequence[str] | None = None, collation: str | None = None) -> DataFrame:
    """Incoming rows whose key is absent from the target (NULL equals NULL).

    No key → every row is new, with a warning. In-batch duplicates survive;
    remove them first with :func:`dedup`. ``collation`` (e.g. ``UTF8_LCASE``,
    ``UNICODE_CI_RTRIM``) compares text keys case- or pad-insensitively, as a
    case-insensitive target database would; the default is binary. Null keys are salted
    (see :func:`_salted_join`), so a hot null key does not land in one task.
    """
    if not keys:
        warnings.warn("no unique identifier for the target: every incoming row is treated as new",
                      stacklevel=2)
        return incoming
    _check_keys(incoming, keys, "incoming")
    tk = list(target_key_names or keys)
    _check_keys(target, tk, "target")
    return _salted_join(incoming, target, keys, tk, collation, lambda x, t, on: x.join(t, on, "left_anti").select(*incoming.columns))


def existing(incoming: DataFrame, target: DataFrame, keys: Sequence[str],
             collation: str | None = None) -> DataFrame:
    """J3-style semi join: incoming rows whose key is present in the target."""
    _check_keys(incoming, keys, "incoming")
    return _salted_join(incoming, target, keys, keys, collation, lambda x, t, on: x.join(t, on, "left_semi").select(*incoming.columns))


def flag_existing(incoming: DataFrame, target: DataFrame, keys: Sequence[str],
                  flag: str = "exists_in_db", collation: str | None = None) -> DataFrame:
    """Every incoming row plus a boolean ``exists_in_db``.

    The target side is reduced to distinct keys first, so the left join never
    multiplies incoming rows.
    """
    _check_keys(incoming, keys, "incoming")

    def flagged(rows: DataFrame, t: DataFrame, on: Column) -> DataFrame:
        joined = rows.join(t.withColumn("_t_hit", F.lit(True)), on, "left")
        return joined.select(*[rows[c] for c in incoming.columns], F.coalesce(F.col("_t_hit"), F.lit(False)).alias(flag))

    return _salted_join(incoming, target, keys, keys, collation, flagged)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the incoming rows it lacks (guarded insert)."""
    return target.unionByName(filter_new(incoming.select(*target.columns), target, keys))


def load_stats(incoming: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with total, new, existing, the share of new rows and the duplicate percentage.

    One pass: the existence flag is computed once and both counts come from
    the same aggregate.
    """
    flagged = flag_existing(incoming.select(*keys), target, keys)
    return flagged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~F.col("exists_in_db")).alias("new_records"),
        F.count_if(F.col("exists_in_db")).alias("existing_records"),
    ).withColumn("filter_rate",
                 F.round(F.try_divide(F.col("new_records"), F.col("total_records")), 6)) \
        .withColumn("duplicate_pct",
                    F.round(F.try_divide(F.col("existing_records") * 100.0, F.col("total_records")), 4))


def preview_stats(incoming: DataFrame, target: DataFrame, keys: Sequence[str],
                  order_by: Sequence[str], n: int = K.PREVIEW_ROWS) -> DataFrame:
    """Check the first ``n`` rows (declared order) and project the duplicate rate.

    The ordered ``limit`` is a distributed top-n (TakeOrderedAndProject), then
    the batch size comes from a plain count.
    """
    sample = incoming.orderBy(*order_by).limit(n)
    flagged = flag_existing(sample.select(*keys), target, keys).select(
        F.lit(True).alias("_in_sample"), F.col("exists_in_db"))
    everyone = incoming.select(F.lit(False).alias("_in_sample"), F.lit(None).cast("boolean").alias("exists_in_db"))
    # one aggregate over the tagged union: batch size and sample statistics together
    out = flagged.unionByName(everyone).agg(
        F.count_if(~F.col("_in_sample")).alias("total_records"),
        F.count_if(F.col("_in_sample")).alias("sample_size"),
        F.count_if(F.col("_in_sample") & F.col("exists_in_db")).alias("sample_duplicates"))
    rate = F.try_divide(F.col("sample_duplicates"), F.col("sample_size"))
    return out.select(
        "total_records", "sample_size", "sample_duplicates",
        F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("duplicate_rate"),
        F.floor(F.col("total_records") * F.coalesce(rate, F.lit(0.0))).cast("bigint")
        .alias("estimated_duplicates"),
    )
