from pyspark.sql import functions as F

from gridload.operators import rules as R
from gridload.plans import pipelines as PL
from gridload.session import scratch_path
from gridload.sources import exports as EX
from gridload.sources import keys as KY


def test_export_scan_keeps_file_and_row_lineage(spark):
    root = scratch_path(spark, "exp")
    df = spark.range(0, 300).selectExpr("id AS k", "CAST(id * 2 AS STRING) AS v")
    EX.write_export(df, f"{root}/a", ["Key #", " Value  "], 3, ["k"])
    spark.createDataFrame([("x",)], "t string").write.text(f"{root}/stray")
    files = EX.admit_files(EX.list_files(spark, root), max_bytes=1_000_000)
    adm = {r.extension: r.admitted for r in files.collect()}
    assert adm[".csv"] is True and adm[".txt"] is False
    paths = [r.path for r in files.filter("admitted").collect()]
    out = EX.read_exports(spark, paths)
    assert set(out.columns) == {"Key ", "Value", "source_file", "sheet_row"}  # strip happens before punctuation removal
    rows = out.collect()
    first = {}
    for r in rows:
        first[r.source_file] = min(first.get(r.source_file, 10**9), int(r["Key "]))
    assert all(int(r["Key "]) - first[r.source_file] + 2 == r.sheet_row for r in rows)
    summ = {r.source_file: r.row_count for r in EX.sheet_summary(out).collect()}
    assert sum(summ.values()) == 300


def test_key_discovery_prefers_verified_priority(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "x int, y int, z string")
    cands = [("uq_x", "UNIQUE", ["x"]), ("pk_xy", "PRIMARY KEY", ["x", "y"]), ("ix_z", "UNIQUE INDEX", ["z"])]
    assert KY.best_key_columns(df, cands) == ["x", "y"]
    v = {r.key_name: r.is_unique for r in KY.verify_candidates(df, cands).collect()}
    assert v == {"uq_x": False, "pk_xy": True, "ix_z": False}
    assert KY.best_key_columns(df, [("uq_x", "UNIQUE", ["x"])]) is None


def test_split_and_log(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    specs = [R.ColumnSpec("name", "name", "STRING", nullable=False)]
    issues = R.validate(df, specs, F.col("id") + 1)
    valid, rejects = PL.split_valid(df, issues, F.col("id") + 1)
    assert sorted(r.id for r in valid.collect()) == [1, 3]
    rej = rejects.collect()
    assert [(r.id, r.reject_rule) for r in rej] == [(2, "required_value")]
    log = PL.load_with_log(valid, rejects, scratch_path(spark, "t"), scratch_path(spark, "q"),
                           scratch_path(spark, "l"), "people", "2025-01-01 00:00:00").collect()
    assert [(r.operation_status, r.record_count) for r in log] == [("PARTIAL", 2)]


def test_failed_load_leaves_no_rows(spark):
    good = spark.createDataFrame([(1,), (2,)], "id int")
    bad = good.select(F.raise_error(F.concat(F.lit("broken "), F.repeat(F.lit("x"), 900))).alias("id"))
    target, quarantine, log = (scratch_path(spark, x) for x in "tql")
    PL.load_with_log(good, good, target, quarantine, log, "people", "2025-01-01 00:00:00", batch_id=0)
    got = PL.load_with_log(good, bad, target, quarantine, log, "people", "2025-01-01 00:00:00", batch_id=1).filter("log_id = 2").collect()
    assert [(r.operation_status, r.record_count) for r in got] == [("FAILED", 0)] and "x" * 900 in got[0].error_message
    assert spark.read.parquet(target).filter("batch_id = 1").count() == 0 and spark.read.parquet(target).count() == 2


def test_exports_with_quotes_line_breaks_and_other_headers(spark, tmp_path):
    import pytest

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text('id,name,note\n1,"He said ""hi"", ok","two\nlines"\n2,b,\n', encoding="utf-8")
    out = EX.read_exports(spark, [str(tmp_path / "a")], glob="*.csv")
    assert sorted((r.id, r.name, r.note, r.sheet_row) for r in out.collect()) == [("1", 'He said "hi", ok', "two\nlines", 2), ("2", "b", None, 3)]
    assert EX.read_exports(spark, [str(tmp_path / "a")], glob="*.csv", max_bytes=5).count() == 0
    (tmp_path / "a" / "y.csv").write_text("name,id,note\nb,1,c\n", encoding="utf-8")
    with pytest.raises(Exception):
        EX.read_exports(spark, [str(tmp_path / "a")], glob="*.csv").collect()


def test_enhanced_load_without_key_keeps_everything(spark):
    batch = spark.createDataFrame([(1,), (1,)], "k int")
    target = spark.createDataFrame([(1,), (1,)], "k int")
    assert PL.enhanced_load(batch, target, [("uq", "UNIQUE", ["k"])], ["k"]).count() == 2


def test_range_partitioned_log_prunes(spark):
    from gridload.sources import sinks as SK

    path = scratch_path(spark, "log")
    rows = [(i, f"2025-{m:02d}-15 10:00:00") for i, m in enumerate(range(1, 13))] + [(99, "2024-12-31 23:00:00")]
    df = spark.createDataFrame(rows, "log_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    SK.write_range_partitioned(df, "ts", path)
    back = spark.read.parquet(path)
    assert {r.log_id: r.partition_no for r in back.collect()}[99] == 1
    q = back.filter(F.col("partition_no") == SK.partition_of("2025-03-15"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_no" in plan
    assert [r.log_id for r in q.collect()] == [2]


def test_insert_if_absent_version(spark):
    from gridload.sources import sinks as SK

    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    inc = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    path = SK.insert_if_absent_version(t, inc, ["k"], "t")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_load_with_log_is_idempotent_per_batch(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    empty = df.limit(0).withColumn("sheet_row", F.lit(0))
    t, q, lg = scratch_path(spark, "t"), scratch_path(spark, "q"), scratch_path(spark, "l")
    for _ in range(2):  # a re-run of batch 7 replaces its output
        PL.load_with_log(df, empty, t, q, lg, "people", "2025-01-01 00:00:00", batch_id=7)
    assert spark.read.parquet(t).count() == 2
    assert [(r.operation_status, r.record_count) for r in spark.read.parquet(lg).collect()] == [("SUCCESS", 2)]
