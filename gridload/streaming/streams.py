"""Structured Streaming: continuous audit (T1), continuous new-record filter.

Both sinks are ``foreachBatch`` writers that are idempotent by ``batchId``:
each micro-batch overwrites its own ``batch_id=<n>`` folder, so a batch
replayed after a failure replaces its earlier output instead of adding to it.
Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc as CD
from ..operators import incremental as I


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB (on the executors' disks, not on the heap)."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _batch_dir(root: str, batch_id: int) -> str:
    return os.path.join(root, f"batch_id={batch_id}")


def audit_stream(stream: DataFrame, key: str, columns: Sequence[str], sink_dir: str,
                 checkpoint: str, table_name: str, as_of: str,
                 available_now: bool = True) -> StreamingQuery:
    """Insert capture (C1) on every micro-batch: detail rows and one log row per batch.

    The batch is read once: the write of the details also counts its records (an observed metric), and the log row
    is made of that count.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("records"))
        details = CD.insert_details(counted, key, columns, log_id=batch_id)
        details.write.mode("overwrite").parquet(_batch_dir(os.path.join(sink_dir, "details"), batch_id))
        count = batch.sparkSession.range(1).select(F.lit(seen.get.get("records", 0)).cast("bigint").alias("record_count"))
        log = CD.log_rows(count, [], F.lit("INSERT"), table_name, as_of, batch_id, F.lit("SUCCESS"))
        log.write.mode("overwrite").parquet(_batch_dir(os.path.join(sink_dir, "log"), batch_id))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def new_records_stream(stream: DataFrame, target: DataFrame, keys: Sequence[str], sink_dir: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Keep the first row of each key that the stream brings, then those absent from the target.

    The keys seen so far are the state of a streaming ``dropDuplicates`` in RocksDB, one small entry a key, so a batch
    looks up its own keys only and never reads earlier output; a key stays known however late it comes again. The
    target's key columns are read once a batch, in an anti-join whose work doesn't depend on the batch's number.
    Nulls in keys equal each other. The survivor of an in-stream duplicate is the first to arrive (not a declared
    row order, unlike the batch ``dedup``). A batch replayed after a failure sees the state it saw first.
    """
    fresh_keys = stream.dropDuplicates(list(keys))
    known = target.select(*keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        I.filter_new(batch, known, keys).write.mode("overwrite").parquet(_batch_dir(sink_dir, batch_id))

    w = fresh_keys.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with rocksdb_state(target.sparkSession):
        return w.start()


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet folder as a stream, a bounded number of files per micro-batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))
