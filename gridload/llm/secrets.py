"""Secret scan over an incremental blob ledger (DataFrame operations only).

Every version of every file is content-addressed (SHA-256 of its text). A ledger keeps the pairs
(blob, rule, rule version) that were scanned; a run scans each distinct blob once, only for the pairs the
ledger lacks, and joins the findings back to every path that holds the blob.

Null text counts as empty. Repeated versions share one blob and get equal findings; an empty table gives
empty results. Extra columns of the input aren't read. Positions are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import stage


@dataclass(frozen=True)
class Rule:
    """A detector: matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The base detectors, in the order in which spans at the same start are listed.
RULES = (
    Rule("assign", 1,
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 and more is the same span as a whole run of [0-9a-f]+ that passes the length test
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)

SPAN = "struct<start:bigint,ord:int,stop:bigint,kind:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` as a bound variable, so that it is computed once a row however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of spans of one rule: the lengths of matches and of the pieces between them give the positions.

    Positions are running sums. An array grows by copying, so n matches are walked in blocks of about the square root of n:
    block totals give each block's start, then each block is walked by itself (n to the power of 1.5 small copies).
    """
    none = F.array().cast(f"array<{SPAN}>")

    def piece(hit: Column, gap: Column) -> Column:  # the last gap has no match: null lengths
        return F.struct(F.char_length(gap).cast("long").alias("gap"), F.char_length(hit).cast("long").alias("len"),
                        F.char_length(F.regexp_extract(hit, rule.pattern, rule.group)).alias("core"))

    def blocks(pieces: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / size).cast("int") - 1),
                           lambda k: F.slice(pieces, k * size + 1, size))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda at, p: at + p["gap"] + F.coalesce(p["len"], F.lit(0)))

    def starts(cut: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(F.transform(cut, total), first, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        stop = start + F.coalesce(p["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        kept = F.when(p["core"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    def walk(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]

    def positions(found: Column) -> Column:
        pieces = F.zip_with(found, F.split(text, rule.pattern, -1), piece)
        cut = _let(pieces, blocks)
        return F.when(F.size(found) > 0, _let(cut, lambda c: F.flatten(F.zip_with(c, starts(c), walk)))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), positions)


def content_address(text: Column) -> Column:
    """Blob id: SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(versions: DataFrame, text: str, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None,
         findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` (blob, kind, version) lacks; return the extended ledger and findings.

    findings: blob, kind, version, start, stop, ord. Both are staged tables; append them to the ledger's
    storage and pass them to the next run, which then scans only new blobs and new rule versions.
    """
    text_of = F.coalesce(F.col(text), F.lit(""))
    blobs = (versions.select(content_address(F.col(text)).alias("blob"), text_of.alias("body"))
             .groupBy("blob").agg(F.first("body").alias("body")))
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<struct<kind:string,version:int>>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", F.col("version").cast("int").alias("version")))
                                          .alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn(
            "seen", F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")))

    def unseen(rule: Rule) -> Column:
        return ~F.array_contains("seen", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))

    none = F.array().cast(f"array<{SPAN}>")
    scanned = stage(blobs.select(
        "blob",
        F.filter(F.array(*[F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
                           for r in rules]), lambda x: x.isNotNull()).alias("done"),
        F.concat(*[F.when(unseen(r), _spans(F.col("body"), r, k)).otherwise(none) for k, r in enumerate(rules)])
        .alias("spans")).where(F.size("done") > 0), "blob-scan")
    new_ledger = scanned.select("blob", F.explode("done").alias("d")).select("blob", "d.kind", "d.version")
    version_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    new = (scanned.select("blob", F.explode("spans").alias("s"))
           .select("blob", "s.kind", version_of[F.col("s.kind")].cast("int").alias("version"), "s.start", "s.stop", "s.ord"))
    return (new_ledger if ledger is None else ledger.select("blob", "kind", "version").unionByName(new_ledger),
            new if findings is None else findings.select(new.columns).unionByName(new))


def findings_by_path(versions: DataFrame, text: str, keep: Sequence[str], findings: DataFrame,
                     rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per version row: the ``keep`` columns and ``spans``, its findings of the rules in force."""
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    # a table of its own, so that the join below has plain exchanges on both sides and a hot blob can be split
    per_blob = stage(findings.where(current[F.col("kind")] == F.col("version"))
                     .select("blob", F.struct("start", "ord", "stop", "kind").alias("s"))
                     .groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("spans")), "blob-findings")
    paths = versions.select(content_address(F.col(text)).alias("blob"), F.struct(*keep).alias("kept"))
    return (paths.join(per_blob, "blob", "left")
            .select("kept.*", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))
