"""Exact candidates for name scorers: pairs of names with enough letters in common.

A scorer built on the indel ratio can't exceed a bound that grows with the letters two names share (counted with
repeats), given their lengths. So a floor on the score asks for a number of common letters. Letters are numbered
within a name (the second ``e`` is ``e2``), ordered rare first over both lists; a name of length n that must share c
letters with any partner shares at least one of its first n - c + 1 with that partner's prefix. Prefix letters and
bands of lengths that fit are equi-join keys; a pair is met under the first letter that both prefixes hold, and is then held
to the bound on its exact common letters, all in the JVM; only what passes reaches a scorer. No pair that can reach the
floor is lost.

There are few letters, so a key may hold a large share of either list: a key's names are dealt into cells of bounded sides,
and cells are dealt to tasks by the pairs they hold, not by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Tp

from ..session import scratch_path

#: Lengths within a band join under one key.
BAND = 4
#: Names of a side of a cell; pairs that a task meets, and names that it numbers, about.
SIDE, PAIRS, NAMES = 1024, 500_000, 20_000
#: Most tasks of a step; beyond it they grow.
MOST_TASKS = 8192
#: Letters told apart in the order by how often they are seen; all others come before them.
KNOWN = 1023


def common_needed(bound: Callable, floor: float, longest: int) -> tuple[list[int], list[int], list[int]]:
    """Per length 0..longest: the fewest common letters with any partner, and the partner's least and greatest length.

    ``bound(n, m, c, least, most)`` is the greatest score of names of n and m letters with c in common. Lengths without any
    possible partner get the range (1, 0).
    """
    need, low, high = [], [], []
    m = np.arange(longest + 1)[:, None]
    c = np.arange(longest + 1)[None, :]
    for n in range(longest + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = (np.nan_to_num(bound(float(n), m.astype(float), c.astype(float), np.minimum, np.maximum)) >= floor - 1e-9) & (c <= np.minimum(n, m))
        fits = np.flatnonzero(ok.any(axis=1))
        need.append(int(ok.argmax(axis=1)[fits].min()) if len(fits) else 0)
        low.append(int(fits.min()) if len(fits) else 1)
        high.append(int(fits.max()) if len(fits) else 0)
    return need, low, high


def _numbered(key: str | None) -> list[int]:
    seen: dict[str, int] = {}
    out = []
    for x in key or "":
        seen[x] = seen.get(x, 0) + 1
        out.append(ord(x) << 32 | seen[x])
    return out


@F.pandas_udf(Tp.ArrayType(Tp.LongType()))
def numbered_letters(keys: pd.Series) -> pd.Series:
    """The letters of a name with their number within it, as longs: code point, then the number in the low 32 bits."""
    return keys.map(_numbered)


def _in_order(seen: list[int]) -> Callable[[Column], Column]:
    """Numbered letters as longs that sort rare ones first; ``seen``: the known letters, frequent ones first."""
    rank = {x: (len(seen) - i) << 53 for i, x in enumerate(seen)}

    @F.pandas_udf(Tp.ArrayType(Tp.LongType()))
    def run(letters: pd.Series) -> pd.Series:
        return letters.map(lambda xs: sorted(rank.get(x, 0) | x for x in map(int, xs)))

    return run


def _tasks(amount: int, each: int) -> int:
    return min(MOST_TASKS, max(1, -(-amount // each)))


def pairs_above(left: DataFrame, right: DataFrame, bound: Callable, floor: float) -> DataFrame:
    """(name, key, target, tkey) of all pairs whose bound reaches ``floor``. ``left``: name, key; ``right``: target, tkey."""
    spark = left.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    about = [df.agg(F.count("*").alias("rows"), F.max(F.char_length(key)).alias("longest")).first() for df, key in ((left, "key"), (right, "tkey"))]
    longest = max((x["longest"] for x in about if x["longest"] is not None), default=None)
    if longest is None:
        return left.join(right, F.lit(False)).select("name", "key", "target", "tkey")
    need, low, high = common_needed(bound, floor, longest)
    a, b = (df.select(name, key).repartition(_tasks(x["rows"], NAMES), name).withColumn(letters, numbered_letters(key))
            for df, x, name, key, letters in ((left, about[0], "name", "key", "letters"), (right, about[1], "target", "tkey", "tletters")))
    seen = a.select(F.explode("letters").alias("x")).union(b.select(F.explode("tletters"))).groupBy("x").count()
    in_order = _in_order([r["x"] for r in seen.orderBy(F.desc("count"), "x").limit(KNOWN).collect()])
    a, b = a.withColumn("letters", in_order("letters")), b.withColumn("tletters", in_order("tletters"))
    # where some lengths need nothing in common, all names of fitting lengths meet under one key
    free = any(not c and lo <= hi for c, lo, hi in zip(need, low, high))

    def at(values: list[int], n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), n + 1)

    def prefix(letters: str) -> Column:
        n = F.size(letters)
        return F.array(F.lit(-1).cast("bigint")) if free else F.slice(letters, 1, F.greatest(F.lit(1), n - at(need, n) + 1))

    mine = (a.withColumn("n", F.size("letters")).withColumn("lo", at(low, F.col("n"))).withColumn("hi", at(high, F.col("n")))
            .where("lo <= hi").withColumn("prefix", prefix("letters")))
    mine = staged(mine, "letters-mine")
    theirs = staged(b.withColumn("m", F.size("tletters")).withColumn("tprefix", prefix("tletters"))
                    .withColumn("band", F.floor(F.col("m") / BAND)), "letters-theirs")
    asking = mine.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / BAND), F.floor(F.col("hi") / BAND)))).withColumn("x", F.explode("prefix"))
    asked = theirs.withColumn("x", F.explode("tprefix"))
    # keys are letters and bands: few, however many names there are
    keys = (asking.groupBy("x", "band").agg(F.count("*").alias("c")).join(asked.groupBy("x", "band").agg(F.count("*").alias("tc")), ["x", "band"])
            .select("x", "band", F.ceil(F.col("c") / SIDE).alias("ps"), F.ceil(F.col("tc") / SIDE).alias("qs"), (F.col("c") * F.col("tc")).alias("pairs")))
    keys = staged(keys, "letters-keys")
    # with fewer parts than a shuffle has by default, Spark would deal the cells once more
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _tasks(int(keys.agg(F.sum(F.col("pairs").cast("decimal(38,0)"))).first()[0] or 0), PAIRS))

    def cells(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        across = {"p": "ps", "q": "qs"}
        dealt = (rows.join(F.broadcast(keys), ["x", "band"]).withColumn(own, F.pmod(F.xxhash64(name), F.col(across[own])))
                 .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(across[other]) - 1))))
        return dealt.drop("ps", "qs", "pairs").repartition(tasks, "x", "band", "p", "q")

    met = (cells(asking, "name", "p", "q").join(cells(asked, "target", "q", "p"), ["x", "band", "p", "q"])
           .where((F.col("m") >= F.col("lo")) & (F.col("m") <= F.col("hi"))
                  & (F.element_at(F.array_intersect("prefix", "tprefix"), 1) == F.col("x"))))
    c = F.size(F.array_intersect("letters", "tletters")).cast("double")
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return met.where(bound(n, m, c, F.least, F.greatest) >= floor - 1e-9).select("name", "key", "target", "tkey")
