"""Change capture and audit: insert/update/delete details, snapshot classification,
operation log rows, surrogate ids and the audit summary view.

Details are generic over table, key and tracked columns (the trigger
generator's intent). Updates are one join on the key followed by one
``explode`` of the changed columns, so each image is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..session import checkpoint_dir

_TYPE_LABELS = {"string": "NVARCHAR", "bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT",
                "double": "FLOAT", "float": "REAL", "boolean": "BIT", "date": "DATE",
                "timestamp": "DATETIME2", "timestamp_ntz": "DATETIME2"}


def _type_label(spark_type: str) -> str:
    return "DECIMAL" if spark_type.startswith("decimal") else _TYPE_LABELS.get(spark_type, spark_type.upper())


def _detail_struct(name: str, old: Column | None, new: Column | None, dtype: str) -> Column:
    return F.struct(F.lit(name).alias("column_name"),
                    (old.cast("string") if old is not None else F.lit(None).cast("string")).alias("old_value"),
                    (new.cast("string") if new is not None else F.lit(None).cast("string")).alias("new_value"),
                    F.lit(dtype).alias("data_type"))


def _details(df: DataFrame, key: str, items: list[Column], log_id) -> DataFrame:
    return df.select(F.lit(log_id).cast("bigint").alias("log_id"),
                     F.col(key).cast("string").alias("record_id"),
                     F.explode(F.array(*items)).alias("d")).select("log_id", "record_id", "d.*")


def insert_details(inserted: DataFrame, key: str, columns: Sequence[str], log_id: int = 1) -> DataFrame:
    """One detail row per inserted record and tracked column (new value only)."""
    types = dict(inserted.dtypes)
    items = [_detail_struct(c, None, F.col(c), _type_label(types[c])) for c in columns]
    return _details(inserted, key, items, log_id)


def delete_details(deleted: DataFrame, key: str, columns: Sequence[str], log_id: int = 1) -> DataFrame:
    """One detail row per deleted record and tracked column (old value only)."""
    types = dict(deleted.dtypes)
    items = [_detail_struct(c, F.col(c), None, _type_label(types[c])) for c in columns]
    return _details(deleted, key, items, log_id)


def diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], log_id: int = 1) -> DataFrame:
    """One row per updated record and changed column. NULL↔value is a change,
    NULL↔NULL is not. Records are matched on the key (inner join)."""
    types = dict(new.dtypes)
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = o.join(n, "_k")
    items = [F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")),
                    _detail_struct(c, F.col(f"_o_{c}"), F.col(f"_n_{c}"), _type_label(types[c])))
             for c in columns]
    return (j.select(F.lit(log_id).cast("bigint").alias("log_id"), F.col("_k").cast("string").alias("record_id"),
                     F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("d"))
            .select("log_id", "record_id", "d.*"))


def touch_modified(new: DataFrame, old: DataFrame, key: str, as_of: str,
                   column: str = "modified_date", columns: Sequence[str] | None = None) -> DataFrame:
    """C2 tail: set the modification time of the records that changed (by default in any common column).

    One left join on the key; unchanged and new records keep the time they have (null without one).
    """
    compared = [c for c in (columns or new.columns) if c in old.columns and c not in (key, column)]
    before = old.select(F.col(key).alias("_k"), F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in compared])
    changed = F.lit(False)
    for c in compared:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    kept = F.col(column).cast("timestamp_ntz") if column in new.columns else F.lit(None).cast("timestamp_ntz")
    joined = new.join(before, F.col(key) == F.col("_k"), "left")
    stamp = F.when(F.col("_old") & changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(kept)
    return joined.select(*[F.col(c) for c in new.columns if c != column], stamp.alias(column))


def classify(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """C4: INSERT / UPDATE / DELETE / UNCHANGED per key from two snapshots (full outer join)."""
    o = old.select(F.col(key).alias("_k"), F.lit(True).alias("_in_old"),
                   *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(F.col(key).alias("_k2"), F.lit(True).alias("_in_new"),
                   *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = o.join(n, o["_k"].eqNullSafe(n["_k2"]), "full_outer")
    changed = None
    for c in columns:
        x = ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
        changed = x if changed is None else changed | x
    kind = (F.when(F.col("_in_old").isNull(), "INSERT").when(F.col("_in_new").isNull(), "DELETE")
            .when(changed, "UPDATE").otherwise("UNCHANGED"))
    return j.select(F.coalesce("_k", "_k2").alias(key), kind.alias("change_type"))


def operation_log(batches: DataFrame, group_cols: Sequence[str], operation: Column | str, table_name: str,
                  as_of: str, first_id: int = 1, status: Column | str = "SUCCESS",
                  username: str = "SYSTEM", schema_name: str = "Data",
                  application: str = "gridload") -> DataFrame:
    """One log row per batch (record count, user default SYSTEM, status) with dense ids.

    Batches are few (one per statement), so ids come from a ``row_number``
    over the aggregated log rows, never over the records themselves.
    """
    op = F.lit(operation) if isinstance(operation, str) else operation
    st = F.lit(status) if isinstance(status, str) else status
    counts = batches.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("record_count"))
    return log_rows(counts, group_cols, op, table_name, as_of, first_id, st, username, schema_name, application)


def log_rows(counts: DataFrame, group_cols: Sequence[str], op: Column, table_name: str, as_of: str, first_id: int,
             st: Column, username: str = "SYSTEM", schema_name: str = "Data", application: str = "gridload") -> DataFrame:
    """The log's columns over one row per statement with ``group_cols`` and ``record_count``."""
    w = Window.orderBy(*group_cols) if group_cols else Window.orderBy(F.lit(1))
    return counts.select(
        (F.lit(first_id - 1) + F.row_number().over(w)).cast("bigint").alias("log_id"),
        *group_cols,
        F.lit(username).alias("username"), op.alias("operation_type"), F.lit(table_name).alias("table_name"),
        F.lit(schema_name).alias("schema_name"), F.col("record_count"), st.alias("operation_status"),
        F.lit(as_of).cast("timestamp_ntz").alias("operation_timestamp"),
        F.lit(application).alias("application_name"))


#: The log's columns that a statement may leave empty, with their types.
LOG_DETAILS = {"session_id": "string", "user_id": "int", "error_message": "string", "execution_time_ms": "int", "source_file": "string",
               "worksheet_name": "string", "ip_address": "string", "additional_info": "string"}


def log_entries(batches: DataFrame, group_cols: Sequence[str], operation: Column | str, table_name: str, as_of: str,
                details: dict[str, Column] | None = None, status: Column | str = "SUCCESS", username: str = "SYSTEM",
                schema_name: str = "Data", application: str = "gridload") -> DataFrame:
    """One entry per group in the log's whole layout, without its id (see :func:`append_log`).

    ``details`` gives any of ``LOG_DETAILS`` as expressions over the group columns and ``record_count``; the others are null.
    A session id that is no UUID becomes null.
    """
    details = dict(details or {})
    if "session_id" in details:
        details["session_id"] = C.to_uuid(details["session_id"])
    if unknown := set(details) - set(LOG_DETAILS):
        raise ValueError(f"not columns of the log: {sorted(unknown)}")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    counts = batches.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("record_count"))
    return counts.select(
        F.lit(username).alias("username"), lit(operation).alias("operation_type"), F.lit(schema_name).alias("schema_name"),
        F.lit(table_name).alias("table_name"), "record_count", lit(status).alias("operation_status"),
        F.lit(as_of).cast("timestamp_ntz").alias("operation_timestamp"), F.lit(application).alias("application_name"),
        *[details.get(c, F.lit(None)).cast(t).alias(c) for c, t in LOG_DETAILS.items()])


def append_log(entries: DataFrame, path: str, batch_id: int, order_by: Sequence[str] = ("operation_type", "table_name")) -> DataFrame:
    """Append entries under dense ids that follow the log's high-water mark; returns the whole log.

    The mark is the largest id of earlier batches (partition folders below ``batch_id``), so a replayed batch gets its ids
    again and replaces its own folder. Batches must come in order. No task sees more than its own partition.
    """
    spark = entries.sparkSession
    try:
        earlier = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
        mark = earlier.agg(F.max("log_id")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        mark = 0
    assign_ids(entries, list(order_by), mark, "log_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return spark.read.parquet(path)


def assign_ids(df: DataFrame, order_by: Sequence, start_after: Column | int = 0,
               name: str = "id") -> DataFrame:
    """Dense ids ``start_after + 1 …`` in the declared order, without a single-task window.

    The sorted data is range partitioned; each row's position inside its
    partition comes from ``monotonically_increasing_id`` and the partition's
    offset from the per-partition counts (one row per partition). The
    sorted, tagged data is checkpointed to the shared folder first, so both
    uses read identical partitions even after a lost executor.
    """
    checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    start = F.lit(start_after) if isinstance(start_after, int) else start_after
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded by the partition count
    return out.withColumn(name, (start + F.col("_off") + pos + 1).cast("bigint")).drop("_pid", "_mid", "_off")


def row_positions(df: DataFrame, name: str = "row_position") -> DataFrame:
    """0-based position of each row in its source file order, from the Parquet row index.

    Files are ordered by path; their offsets come from per-file counts (one
    row per file), so no task sees more than its own split.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_ri"))
    counts = tagged.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_f", F.coalesce(F.sum("_n").over(
        Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per file: AQE broadcasts it once measured small
    return tagged.join(offsets, "_f").withColumn(
        name, (F.col("_off") + F.col("_ri")).cast("bigint")).drop("_f", "_ri", "_off")


def audit_summary(log: DataFrame, errors: DataFrame) -> DataFrame:
    """Log rows with decoded status/operation labels and the count of validation errors (0 if none).

    The correlated count is a pre-aggregated left join.
    """
    per_log = errors.groupBy("log_id").agg(F.count(F.lit(1)).alias("_cnt"))
    j = log.join(per_log, "log_id", "left")
    return j.select(
        "log_id", "username", "operation_type", "table_name", "record_count", "operation_status",
        "operation_timestamp",
        C.decode("operation_status", K.STATUS_LABELS).alias("status_label"),
        C.decode("operation_type", K.OPERATION_LABELS).alias("operation_label"),
        F.coalesce(F.col("_cnt"), F.lit(0)).alias("validation_errors"))


def validation_error_rows(issues: DataFrame, log_id: Column | int, as_of: str) -> DataFrame:
    """Issues projected to the validation-error layout, linked to a log id, with dense error ids."""
    lid = F.lit(log_id) if isinstance(log_id, int) else log_id
    base = issues.select(
        lid.cast("bigint").alias("log_id"), F.col("row_number").cast("int").alias("row_number"),
        "column_name", F.col("rule_name").alias("error_type"), F.col("message").alias("error_description"),
        F.col("value").alias("invalid_value"), F.col("suggested_fix").alias("expected_format"),
        F.lit(as_of).cast("timestamp_ntz").alias("error_timestamp"))
    return assign_ids(base, ["row_number", "column_name", "error_type", "error_description", "invalid_value"],
                      0, "error_id")
