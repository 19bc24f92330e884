"""End-to-end loads: base load (E1), enhanced load (E2), validated split and write (S5),
batch load with outcome logging (C8).

Each load is one lazy plan up to its write; statistics are aggregates of
the same plan, and the typed batch is checkpointed once to the shared
folder so that the write and the statistics do not recompute the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc as CD
from ..operators import dedup as D
from ..operators import incremental as I
from ..operators import rules as R
from ..operators import typing_ops as TY
from ..session import scratch_path
from ..sources import exports as EX
from ..sources import keys as KY


def base_load(sheet: DataFrame, mapping: Mapping[str, Mapping], types: Mapping[str, str],
              drop_unmapped: bool = True) -> DataFrame:
    """Clean (drop all-null columns and rows), map headers, cast, drop rows null after casts.

    Validation reports but never filters here (as in the reference); use
    :func:`split_valid` to act on it.
    """
    cleaned = TY.drop_all_null_rows(TY.drop_all_null_columns(sheet))
    mapped = TY.apply_mapping(cleaned, mapping, drop_unmapped=drop_unmapped)
    typed = TY.cast_columns(mapped, types)
    return TY.drop_all_null_rows(typed)


def base_load_counts(sheet: DataFrame, loaded: DataFrame) -> DataFrame:
    """E1 totals: rows read, rows kept after cleaning and casting, rows skipped (read − kept),
    from one aggregate over the two tagged inputs."""
    tagged = sheet.select(F.lit(True).alias("_read")).unionByName(loaded.select(F.lit(False).alias("_read")))
    out = tagged.agg(F.count_if(F.col("_read")).alias("rows_read"), F.count_if(~F.col("_read")).alias("rows_kept"))
    return out.withColumn("rows_skipped", F.col("rows_read") - F.col("rows_kept"))


@dataclass
class FileLoad:
    rows: DataFrame  #: typed rows with ``source_file`` and ``sheet_row``
    files: DataFrame  #: every file with its header, and a reason where it was rejected
    issues: DataFrame  #: validation issues, with ``source_file``
    counts: DataFrame  #: one row of totals


def file_load(spark: SparkSession, folder: str, mapping: Mapping[str, Mapping], types: Mapping[str, str],
              specs: Sequence[R.ColumnSpec] = (), max_bytes: int | None = None, multi_line: bool = True,
              as_of: str = "2025-01-01 00:00:00") -> FileLoad:
    """E1 from files: admit, read files of unlike headers, clean, map, validate, cast, drop rows null after casts.

    The sheet rows are staged once in the shared folder, so the steps after it read columns, not files. Validation
    reports on the mapped text and filters nothing; a row keeps its file and sheet row to the end. Totals: files admitted
    and rejected, header layouts, rows read, kept and skipped, issues.
    """
    lineage = ["source_file", "sheet_row"]

    def filled(df: DataFrame) -> DataFrame:
        return df.na.drop(how="all", subset=[c for c in df.columns if c not in lineage])

    raw, files = EX.read_unlike(spark, folder, max_bytes=max_bytes, multi_line=multi_line)
    path = scratch_path(spark, "sheet-rows")
    raw.write.parquet(path)
    sheet = spark.read.schema(raw.schema).parquet(path)
    cleaned = filled(TY.drop_all_null_columns(sheet)) if not sheet.isEmpty() else sheet
    mapped = TY.apply_mapping(cleaned, mapping | {c: {"target": c, "confidence": 1.0} for c in lineage}, drop_unmapped=True)
    typed = filled(TY.cast_columns(mapped, {c: t for c, t in types.items() if c in mapped.columns})) if len(mapped.columns) > 2 else mapped
    # a sheet row is unique within its file only
    at = F.struct("source_file", "sheet_row")
    numbered = mapped.withColumn("_at", F.xxhash64(at))
    issues = (R.validate(numbered, list(specs), F.col("_at"), as_of=as_of)
              .join(numbered.select(F.col("_at").alias("row_number"), *lineage), "row_number", "left").drop("row_number"))
    totals = (sheet.select(F.lit("read").alias("_of"))
              .unionByName(typed.select(F.lit("kept").alias("_of"))).unionByName(issues.select(F.lit("issue").alias("_of")))
              .unionByName(files.select(F.when(F.col("admitted"), "admitted").otherwise("rejected").alias("_of")))
              .unionByName(files.filter("admitted").select("header").distinct().select(F.lit("layout").alias("_of"))))
    n = lambda kind: F.count_if(F.col("_of") == kind)
    counts = totals.agg(n("admitted").alias("files_admitted"), n("rejected").alias("files_rejected"), n("layout").alias("layouts"),
                        n("read").alias("rows_read"), n("kept").alias("rows_kept"), (n("read") - n("kept")).alias("rows_skipped"),
                        n("issue").alias("issues"))
    return FileLoad(typed, files, issues, counts)


def enhanced_load(batch: DataFrame, target: DataFrame, candidates, order_by: Sequence[str],
                  keep: str = "first") -> DataFrame:
    """Discover the best verified key of the target, drop in-batch duplicates on it (W1),
    then keep rows absent from the target (J1). No key → every row is new."""
    keys = KY.best_key_columns(target, candidates)
    if not keys:
        return batch
    return I.filter_new(D.dedup(batch, keys, order_by, keep), target, keys)


@dataclass
class EnhancedLoad:
    rows: DataFrame  #: the rows to insert
    counts: DataFrame  #: one row: rows_read, duplicates_in_batch, existing, inserted


def enhanced_load_totals(batch: DataFrame, target: DataFrame, candidates, order_by: Sequence[str],
                         keep: str = "first") -> EnhancedLoad:
    """E2 with its totals. The typed batch and the flagged rows are each written once to the shared folder; the rows to
    insert and all totals are read from there, so nothing is computed twice and a lost executor changes no total.

    Without a verified key of the target every row is new. An empty batch gives zeros.
    """
    spark, keys = batch.sparkSession, KY.best_key_columns(target, candidates)

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    read = staged(batch, "load-batch")
    flag = "_existing"
    flagged = (staged(I.flag_existing(D.dedup(read, keys, order_by, keep), target, keys, flag=flag), "load-flagged") if keys
               else read.withColumn(flag, F.lit(False)))
    tagged = (read.select(F.lit("read").alias("_of"))
              .unionByName(flagged.select(F.when(F.col(flag), "existing").otherwise("inserted").alias("_of"))))
    n = lambda kind: F.count_if(F.col("_of") == kind)
    counts = tagged.agg(n("read").alias("rows_read"), (n("read") - n("existing") - n("inserted")).alias("duplicates_in_batch"),
                        n("existing").alias("existing"), n("inserted").alias("inserted"))
    return EnhancedLoad(flagged.filter(~F.col(flag)).drop(flag), counts)


def split_valid(df: DataFrame, issues: DataFrame, row_number: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without ERROR issues, and rejected rows with their first error (rule, message).

    Issues are reduced to one row per sheet row before joining back, so a
    row with many issues does not multiply.
    """
    errs = (issues.filter(F.col("severity") == "ERROR")
            .groupBy(F.col("row_number").alias("_rn"))
            .agg(F.min(F.struct("rule_name", "message", "column_name")).alias("_first")))
    tagged = df.withColumn("_rn", row_number.cast("bigint"))
    valid = tagged.join(errs, "_rn", "left_anti").drop("_rn")
    rejects = tagged.join(errs, "_rn", "inner").select(
        *df.columns, F.col("_rn").alias("sheet_row"), F.col("_first.rule_name").alias("reject_rule"),
        F.col("_first.message").alias("reject_reason"), F.col("_first.column_name").alias("reject_column"))
    return valid, rejects


def load_with_log(valid: DataFrame, rejects: DataFrame, target_path: str, quarantine_path: str,
                  log_path: str, table_name: str, as_of: str, batch_id: int = 0, schema_name: str = "Data",
                  username: str = "SYSTEM", application: str = "gridload", session_id: str | None = None,
                  user_id: int | None = None, source_file: str | None = None, worksheet_name: str | None = None,
                  ip_address: str | None = None, additional_info: str | None = None) -> DataFrame:
    """Write the valid rows and the rejects, then an operation-log row in the log's layout:
    SUCCESS with the count, PARTIAL when rows were rejected, FAILED with 0 and the whole message.

    Every write goes to its own ``batch_id=<n>`` folder in overwrite mode, so re-running a
    load after a failure replaces that batch's output instead of appending it twice. When either write
    fails, both of the batch's folders are replaced by empty ones, so a failed load leaves no rows.
    """
    import time

    from pyspark.sql import Observation

    spark = valid.sparkSession
    started = time.monotonic()

    def part(path: str) -> str:
        return f"{path}/batch_id={batch_id}"

    try:
        # counts are observed during the writes themselves: no second pass over the batch
        ov, orj = Observation("valid_rows"), Observation("rejected_rows")
        valid.observe(ov, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(part(target_path))
        rejects.observe(orj, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(part(quarantine_path))
        n_valid, n_rej = ov.get["n"], orj.get["n"]
        status, message, n = ("PARTIAL" if n_rej else "SUCCESS"), None, n_valid
    except Exception as exc:  # the failure itself is what gets logged
        status, message, n = "FAILED", str(exc), 0
        for rows, path in ((valid, target_path), (rejects, quarantine_path)):
            spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(part(path))
    ms = int((time.monotonic() - started) * 1000)
    log = spark.createDataFrame(
        [(batch_id + 1, session_id, user_id, username, "BULK_INSERT", schema_name, table_name, n, status, message, ms, application,
          source_file, worksheet_name, ip_address, additional_info)],
        "log_id bigint, session_id string, user_id int, username string, operation_type string, schema_name string, "
        "table_name string, record_count bigint, operation_status string, error_message string, execution_time_ms bigint, "
        "application_name string, source_file string, worksheet_name string, ip_address string, additional_info string",
    ).withColumn("operation_timestamp", F.lit(as_of).cast("timestamp_ntz"))
    log.write.mode("overwrite").parquet(part(log_path))
    return spark.read.parquet(log_path)


def quality_report(df: DataFrame, specs: Sequence[R.ColumnSpec], row_number: Column,
                   constraints: dict | None = None, as_of: str = "2025-01-01 00:00:00"):
    """Issues and verdict of one batch."""
    issues = R.validate(df, specs, row_number, constraints, as_of=as_of)
    return issues, R.verdict(issues, df)
