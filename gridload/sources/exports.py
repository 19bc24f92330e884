"""Sheet exports: file admission (S3), scan with lineage (S2) and per-source summary.

Workbooks arrive as CSV (or Parquet) exports; many files are read by one
job. Every column is read as text (no ``inferSchema``), and each row keeps
its source file and its sheet row (position in the file + 2 for the header
and 1-based numbering).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

DEFAULT_EXTENSIONS = (".csv",)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files under ``folder`` with size and name; the content column is never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select(F.col("path"), F.col("length").alias("size_bytes")))
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def admit_files(files: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                max_bytes: int | None = None) -> DataFrame:
    """S3: extension in the allowed set and size within the limit; a reason otherwise."""
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))
    bad_ext = ~ext.isin(*[e.lower() for e in extensions])
    too_big = F.lit(False) if max_bytes is None else (F.col("size_bytes") > max_bytes)
    reason = (F.when(bad_ext, F.concat(F.lit("unsupported extension "), ext))
              .when(too_big, F.lit("file too large")))
    return files.withColumn("extension", ext).withColumn("reason", reason) \
        .withColumn("admitted", F.col("reason").isNull())


def read_exports(spark: SparkSession, paths: Sequence[str], fmt: str = "csv",
                 clean_headers: bool = True, multi_line: bool = True, glob: str | None = None,
                 max_bytes: int | None = None) -> DataFrame:
    """Read admitted exports, all columns as text, with ``source_file`` and ``sheet_row``.

    Quotes inside quoted cells are doubled. With ``multi_line`` (the default) cells may hold line breaks and a
    file is read by one task; without it, files declared free of line breaks in cells stay splittable. All files
    need the same header in the same order; another header fails the read instead of mixing up columns.
    ``glob`` (on the file name) and ``max_bytes`` admit files by rule (S3) while they are listed, so no path list
    passes through the driver.

    The sheet row is derived without a single-task window: the position of
    a row inside its split comes from ``monotonically_increasing_id`` minus
    the split's first id, and each split's offset inside its file from
    per-split counts (one row per split).
    """
    if fmt == "csv":
        reader = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
                  .option("multiLine", multi_line).option("enforceSchema", False))
        raw = (reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True) if glob else reader).csv(list(paths))
    else:
        raw = spark.read.parquet(*paths)
        raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    if max_bytes is not None:
        raw = raw.filter(F.col("_metadata.file_size") <= max_bytes)
    if clean_headers:
        raw = raw.toDF(*[C.clean_header(c, i) for i, c in enumerate(raw.columns)])
    tagged = raw.select("*", F.col("_metadata.file_path").alias("source_file"),
                        F.col("_metadata.file_block_start").alias("_blk"),
                        F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy("source_file", "_blk").agg(F.min("_mid").alias("_first"),
                                                       F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per split: grows with the data, so AQE decides on broadcasting after measuring it
    out = tagged.join(splits.select("source_file", "_blk", "_first", "_off"), ["source_file", "_blk"])
    return out.withColumn("sheet_row", (F.col("_off") + F.col("_mid") - F.col("_first") + 2).cast("bigint")) \
        .drop("_blk", "_mid", "_first", "_off")


#: Different header lines that one folder may hold; each is one scan, so their number is checked.
MAX_LAYOUTS = 1000


def file_headers(spark: SparkSession, folder: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """path, header: the first line of every non-empty file, found by a scan that shuffles one row per file."""
    lines = (spark.read.option("recursiveFileLookup", "true").text(folder)
             .select(F.col("_metadata.file_path").alias("at"), F.lower("_metadata.file_name").alias("name"),
                     F.col("_metadata.file_block_start").alias("block"), F.col("value"))
             .filter("block = 0").filter(reduce(lambda x, y: x | y, [F.col("name").endswith(e.lower()) for e in extensions])))
    first = lines.withColumn("line", F.monotonically_increasing_id()).groupBy("at").agg(F.min(F.struct("line", "value")).alias("f"))
    path = F.url_decode(F.replace("at", F.lit("+"), F.lit("%2B")))  # file paths in the metadata are encoded
    return first.select(path.alias("path"), F.regexp_replace("f.value", "^\ufeff", "").alias("header"))


def _one_slash(path) -> Column:
    """``file:///a`` and ``file:/a`` as one spelling."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def read_unlike(spark: SparkSession, folder: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS, max_bytes: int | None = None,
                multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S2 and S3 for a folder of files with unlike headers: (rows, files).

    Files are admitted by rule, grouped by their header line, and each group is read on its own; groups are
    united by cleaned column name, and a column that a group lacks is null there. ``files`` holds path, header, admitted
    and a reason for each file: besides the admission rules, a file is rejected when its cleaned header names a column
    twice. Files of zero bytes aren't listed by Spark and so don't show up. A header is the file's first line, so it
    can't hold a line break. The driver gets one
    row per header, with its files (which it lists to read them anyway); over ``MAX_LAYOUTS`` headers raise.
    """
    listed = admit_files(list_files(spark, folder), extensions, max_bytes).withColumn("_p", _one_slash("path"))
    headers = file_headers(spark, folder, extensions).select(_one_slash("path").alias("_p"), "header")
    seen = listed.join(headers, "_p", "left").drop("_p")
    layouts = seen.filter("admitted and header is not null").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).limit(
        MAX_LAYOUTS + 1).collect()
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"over {MAX_LAYOUTS} different headers under {folder}")
    good, twice = [], []
    for row in sorted(layouts, key=lambda r: r["header"]):
        names = [C.clean_header(c, i).lower() for i, c in enumerate(next(csv.reader([row["header"]]), []))]
        (good if len(set(names)) == len(names) else twice).append(row)
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("header").isNull(), "no header line")
              .when(F.col("header").isin([r["header"] for r in twice]), "repeated column name"))
    files = seen.select("path", "file_name", "extension", "size_bytes", "header", reason.alias("reason")).withColumn("admitted", F.col("reason").isNull())
    parts = [read_exports(spark, r["paths"], multi_line=multi_line) for r in good]
    if not parts:
        return spark.createDataFrame([], "source_file string, sheet_row bigint"), files
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), files


def sheet_summary(df: DataFrame, source_col: str = "source_file") -> DataFrame:
    """S4 per file: rows, columns (without lineage), has data."""
    n_cols = len([c for c in df.columns if c not in (source_col, "sheet_row")])
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.col(source_col), "row_count", F.lit(n_cols).alias("column_count"), (F.col("row_count") > 0).alias("has_data"))


def write_export(df: DataFrame, folder: str, headers: Sequence[str] | None = None, files: int = 4,
                 order_by: Sequence[str] | None = None) -> str:
    """Write a table as CSV export files (fixture helper). With ``order_by`` the rows are range
    partitioned and sorted, so each file holds a contiguous, ordered slice."""
    if order_by:
        df = df.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by)
    out = df.toDF(*headers) if headers else df
    out.write.mode("overwrite").option("header", True).csv(folder)
    return folder
