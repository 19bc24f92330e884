"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 60-bit key hash. A bucket splits on its next bit only while
its bytes pass the limit, so every shard is the shortest prefix that fits. Bytes are summed once per cell of
a fine prefix (a few bits deeper than the mean shard needs) and rolled up to all coarser prefixes; only cells
that still don't fit go to a round with more bits. The directory has a row per cell and is joined, never
collected; above ``SENT_ROWS`` rows both sides of the join are shuffled, so the driver's memory doesn't follow the input.

Rows with equal keys can't be split by bits. If they pass the limit together, they form a chain of overflow
pages ``<prefix>.<salt>.<page>``, each within the limit unless one row alone is larger. Null text has 0 bytes, a
null id hashes as an empty string, repeated rows are dealt out as separate rows, an empty table gives an empty
result. Input columns are kept in one struct, so names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import stage

BITS = 60

#: Rows of a directory that may be sent whole to every task, through the driver (about 150 bytes a row there).
SENT_ROWS = 20_000


def shard_key(col: Column) -> Column:
    """60 hash bits (an MD5's first), so that any engine can recompute them."""
    digest = F.md5(F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _cell(depth: int) -> Column:
    return F.shiftright("key", BITS - depth)


def _label(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth.cast("int"), F.lit("0")))


def _dealt(table: DataFrame) -> DataFrame:
    """A staged table as the smaller side of a join. Spark would go by its files' bytes, of which packed rows have few."""
    return table.hint("merge") if table.count() > SENT_ROWS else table


def _round(live: DataFrame, depth: int, above: int, max_bytes: int) -> DataFrame:
    """Per cell of ``depth`` bits: the shortest prefix that fits (depth null if none of up to ``depth`` bits does)."""
    cells = stage(live.groupBy(_cell(depth).alias("cell")).agg(F.sum("n_bytes").alias("b")), "shard-cells")

    def each(least: int) -> DataFrame:
        return cells.select("cell", "b", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - d)"))

    fits = stage(each(above).groupBy("d", "prefix").agg(F.sum("b").alias("shard_bytes")).where(F.col("shard_bytes") <= max_bytes),
                 "shard-prefixes")
    least = fits.agg(F.min("d")).first()[0]  # shorter prefixes would only gather many cells under one key
    best = (each(depth if least is None else least).join(fits.hint("merge"), ["d", "prefix"]).groupBy("cell")
            .agg(F.min(F.struct("d", "prefix", "shard_bytes")).alias("s")))
    return stage(cells.select("cell").join(best, "cell", "left").select(
        "cell", F.col("s.d").alias("depth"), _label(F.col("s.prefix"), F.col("s.d")).alias("shard"), "s.shard_bytes"),
        "shard-directory")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 64 << 20) -> DataFrame:
    """Rows with ``row`` (struct of the input's columns), n_bytes, shard, depth and shard_bytes."""
    key = shard_key(F.col(id_col)).alias("key")
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    live = stage(docs.select(key, n_bytes), "shard-sizes")
    total = live.agg(F.sum("n_bytes")).first()[0] or 0
    depth, above, rounds = min(BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes)))) + 6), 0, []
    while True:
        directory = _round(live, depth, above, max_bytes)
        rounds.append((depth, directory))
        wide = directory.where(F.col("depth").isNull()).select("cell")
        if depth == BITS or wide.isEmpty():
            break
        live = live.join(_dealt(wide.withColumnRenamed("cell", "c")), _cell(depth) == F.col("c"), "left_semi")
        depth, above = min(BITS, depth + 6), depth + 1
    out = docs.select(F.struct("*").alias("row"), key, n_bytes)
    found = None
    for depth, directory in rounds:
        part = directory.where(F.col("depth").isNotNull()) if len(rounds) > 1 else directory
        got = part.select(F.col("cell").alias(f"cell{depth}"), F.struct("depth", "shard", "shard_bytes").alias(f"at{depth}"))
        out = out.withColumn(f"cell{depth}", _cell(depth)).join(_dealt(got), f"cell{depth}", "left").drop(f"cell{depth}")
        found = F.col(f"at{depth}") if found is None else F.coalesce(found, F.col(f"at{depth}"))
    out = out.withColumn("at", found)
    plain = out.select("row", "n_bytes", F.col("at.shard").alias("shard"), F.col("at.depth").alias("depth"),
                       F.col("at.shard_bytes").alias("shard_bytes"))
    last_depth, last = rounds[-1]
    if last_depth < BITS or last.where(F.col("depth").isNull()).isEmpty():
        return plain
    return plain.where(F.col("shard").isNotNull()).unionByName(_overflow(out.where(F.col("at.shard").isNull()), max_bytes))


def _overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Pages for rows whose equal keys don't fit: dealt over salts, then cut by running bytes within each."""
    groups = stage(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most")), "shard-overflow")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("n") / 1000)).cast("long")
    w = Window.partitionBy("key", "salt").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    width = F.greatest(F.lit(1), F.lit(max_bytes) - F.col("most") + 1)
    paged = (rows.join(_dealt(groups), "key").withColumn("salt", salt)
             .withColumn("page", F.floor((F.greatest(F.sum("n_bytes").over(w), F.lit(1)) - 1) / width)))
    label = F.concat_ws(".", _label(F.col("key"), F.lit(BITS)), F.col("salt").cast("string"), F.col("page").cast("string"))
    return paged.select("row", "n_bytes", label.alias("shard"), F.lit(BITS).alias("depth"),
                        F.sum("n_bytes").over(Window.partitionBy("key", "salt", "page")).alias("shard_bytes"))
