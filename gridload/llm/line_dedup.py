"""Line removal by site-relative frequency.

Per host, the number of pages that contain a line is divided by the host's pages; lines above the ratio are
boilerplate of that host and dropped from all its pages, on hosts of any size. A line must stand on two pages of
different text: one page, or copies of one page, say nothing about what their host repeats. Counts are
partial and final aggregates over (host, line hash); what a page loses is found by its content (host, text hash),
so copies are looked up once.

Lines end at a newline; a trailing carriage return isn't part of the line. Blank lines are never counted or
dropped. Null text stays null, with 0 lines; null hosts form one host. Repeated rows are separate pages. An empty
table gives an empty result. Input columns are kept in one struct, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import stage


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"\r$", ""))


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1) -> DataFrame:
    """hkey, line: hash of each line above the ratio in its host, with pages and host_pages."""
    pages = docs.select(_host_key(host_col), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("body"))
    totals = pages.groupBy("hkey").agg(F.count("*").alias("host_pages"))
    counts = (pages.select("hkey", "page", F.explode(_lines(F.col("body"))).alias("line"))
              .groupBy("hkey", "line").agg(F.count("*").alias("pages"), F.min("page").alias("least"), F.max("page").alias("most"))
              .where("least != most").drop("least", "most"))
    return counts.join(totals, "hkey").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def _host_key(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n")).alias("hkey")


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _lines(text: Column) -> Column:
    return F.array_distinct(F.transform(_filled(text), _line_hash))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1) -> DataFrame:
    """Rows with ``row`` (struct of the input's columns), text (without boilerplate lines), n_lines, n_dropped."""
    bad = stage(boilerplate_lines(docs, text_col, host_col, ratio).select("hkey", "line"), "line-boilerplate")
    pages = docs.select(_host_key(host_col), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("body"),
                        F.struct("*").alias("row"))
    losses = (pages.select("hkey", "page", F.explode(_lines(F.col("body"))).alias("line")).join(bad, ["hkey", "line"])
              .groupBy("hkey", "page").agg(F.collect_set("line").alias("bad")))
    lines = F.split("body", "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains("bad", _line_hash(x)))
    whole = F.col("bad").isNull() | F.col("body").isNull()
    n = F.when(F.col("body").isNull(), 0).otherwise(F.size(lines))
    return (pages.join(losses, ["hkey", "page"], "left")
            .select("row", F.when(whole, F.col("body")).otherwise(F.array_join(kept, "\n")).alias("text"),
                    n.cast("long").alias("n_lines"),
                    F.when(whole, 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped")))
