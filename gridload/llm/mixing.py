"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source, documents are ordered by that key in key ranges
(about the square root of the source's rows each), running token sums are taken per range and offset by
the sums of the ranges before, and the source is cut at its exact token budget: whole epochs first, then the
documents below the cut; the one at the cut is taken in part. No task holds a source; a source with a
third of all rows just has more ranges.

Null text has no tokens; null sources form one source, ordered last; a source without tokens gets target 0.
Repeated rows are separate documents (rows of equal id and text are interchangeable and share a key range). An empty table gives an empty result.
Input columns are kept in one struct, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import WORD, source_order, stage
from gridload.operators.cdc import assign_ids

KEY_BITS = 60


def random_key(ident: Column, text: Column, seed: str) -> Column:
    """Hash-random key of a document: the first 60 bits of an MD5 of id and text, so that any engine can recompute it.

    The text is part of it because many rows may share an id (or have none); equal keys would be one key range.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"),
                            F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """Per source (``skey``): rows, source_size and target.

    Weights repeat over the sources in code point order. Targets share the total size by weight; none
    passes ``cap`` times its source's size, and what is above goes to the others by weight (one level
    ``lam`` per weight unit, raised until no target is above its cap).
    """
    stats = sized.groupBy("skey", "src").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = assign_ids(stage(stats, "mix-sources"), source_order(F.col("src")), name="rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    srcs = stage(ranked.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(cap))), "mix-targets")
    lam, capped = 0.0, -1
    while True:  # each turn is a one-row aggregate; the set of capped sources only grows
        full = F.col("w") * F.lit(lam) > F.col("top") if capped >= 0 else F.lit(False)
        row = srcs.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("top")).otherwise(0.0)).alias("used"),
                       F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        if row["total"] is None or not row["w"] or row["n"] == capped:
            break
        lam, capped = (row["total"] - row["used"]) / row["w"], row["n"]
    return srcs.withColumn("target", F.least(F.col("w") * F.lit(lam), F.col("top"))).select(
        "skey", "n", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, seed: str = "mix-1:", carry: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (tokens the mix takes, repeats counted).

    With ``carry`` each row also has ``row``, a struct of the input's columns.
    """
    src = F.col(source_col).cast("string")
    narrow = [F.col(id_col).alias("id"), src.alias("src"),
              F.coalesce(F.concat(F.lit("s"), src), F.lit("n")).alias("skey"),
              token_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), F.col(text_col), seed).alias("key"),
              F.xxhash64(text_col).alias("tie")]
    sized = stage(docs.select(*narrow), "mix-sizes")
    targets = stage(source_targets(sized, weights, cap), "mix-budgets")
    salts = 16
    spread = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    budget = F.round("target").cast("long")
    ranges = F.ceil(F.sqrt("n")).cast("long")

    def placed(df: DataFrame) -> DataFrame:
        """Attach the source's figures (salted, so a hot source spreads) and the key range."""
        return (df.withColumn("salt", (F.col("key") % salts).cast("int")).join(spread, ["skey", "salt"])
                .withColumn("range", F.shiftright(F.shiftright("key", KEY_BITS - 31) * ranges, 31)))

    offsets = stage(placed(sized).groupBy("skey", "range").agg(F.sum("size").alias("in_range"))
                    .withColumn("offset", F.coalesce(F.sum("in_range").over(
                        Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                    .drop("in_range"), "mix-offsets")
    rows = docs.select(*narrow, F.struct("*").alias("row")) if carry else sized
    in_range = Window.partitionBy("skey", "range").orderBy("key", "id", "size", "tie")
    before = (F.col("offset") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (placed(rows).join(offsets, ["skey", "range"])
            .withColumn("epochs", epochs).withColumn("before", before)
            .select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
                    *(["row"] if carry else [])))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per epoch in which a document is taken.

    The document at a source's cut has its text cut after its last taken word (and ``n_chars``, if there is
    such a column, set to match). Documents that aren't taken, or have no words, aren't in the mix.
    """
    m = mix(docs, id_col, text_col, source_col, carry=True, **options)
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    part = (F.col("taken") - whole * F.col("size")).cast("long")
    copies = (m.where(F.col("taken") > 0)
              .withColumn("words", F.explode(F.concat(
                  F.array_repeat(F.col("size"), whole.cast("int")),
                  F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))))))
    pieces = F.slice(F.split(F.col(f"row.{text_col}"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1,
                     F.greatest(F.col("words"), F.lit(1)).cast("int"))
    head = F.array_join(pieces, "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col(f"row.{text_col}"))
    out = copies.select(text.alias("cut"), "row")
    fields = []
    for f in docs.schema.fields:
        if f.name == text_col:
            fields.append(F.col("cut").alias(f.name))
        elif f.name == "n_chars":
            fields.append(F.char_length("cut").cast(f.dataType).alias(f.name))
        else:
            fields.append(F.col("row")[f.name].alias(f.name))
    return out.select(*fields)
