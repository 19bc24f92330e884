"""Whole loads and written tables: E2 totals, E4 from its distinct join, J6's chain, C5's appended log, S6/C2 in buckets."""

import os

import pytest
from pyspark.sql import functions as F

from gridload.functions import columns as C
from gridload.operators import cdc as CD
from gridload.operators import profile as PR
from gridload.operators import recon as RC
from gridload.plans import pipelines as PL
from gridload.sources import keys as KY
from gridload.sources import sinks as SK

AS_OF = "2025-01-01 00:00:00"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_load_totals_count_repeats_existing_and_new(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (None, "m"), (4, "w")], "id int, v string")
    got = PL.enhanced_load_totals(batch, target, [("PK", "PRIMARY KEY", ["id"])], ["v"])
    assert got.counts.first().asDict() == {"rows_read": 6, "duplicates_in_batch": 2, "existing": 1, "inserted": 3}
    assert rows(got.rows) == sorted([(3, "z"), (None, "m"), (4, "w")], key=repr)


@pytest.mark.parametrize("keep, inserted", [("last", 3), ("none", 2)])
def test_load_totals_follow_keep(spark, keep, inserted):
    target = spark.createDataFrame([(9, "a")], "id int, v string")
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (1, "q"), (3, "z"), (4, "w")], "id int, v string")
    counts = PL.enhanced_load_totals(batch, target, [("PK", "PRIMARY KEY", ["id"])], ["v"], keep).counts.first()
    assert (counts["rows_read"], counts["existing"], counts["inserted"]) == (5, 0, inserted)
    assert counts["duplicates_in_batch"] == 5 - inserted


def test_load_totals_without_key_or_rows(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    batch = spark.createDataFrame([(1, "x"), (1, "x")], "id int, v string")
    got = PL.enhanced_load_totals(batch, target, [("PK", "PRIMARY KEY", ["id"])], ["v"])
    assert got.counts.first().asDict() == {"rows_read": 2, "duplicates_in_batch": 0, "existing": 0, "inserted": 2}
    empty = PL.enhanced_load_totals(batch.filter("false"), target, [("PK", "PRIMARY KEY", ["id", "v"])], ["v"])
    assert empty.counts.first().asDict() == {"rows_read": 0, "duplicates_in_batch": 0, "existing": 0, "inserted": 0}
    assert empty.rows.count() == 0


CAPTURES = "id_number string, capture_id string, account_no string, collection_date string, payer_name string, value string"
BUDGET = "invoice string, third_id string, third_name string, value string, code string"


def test_payments_join_once_and_survive_odd_packages(spark):
    captures = spark.createDataFrame([("9", "007", "A", "2024-03-05", "N", "5"), ("9", "007", "A", "2024-03-05", "N", "5"),
                                      (None, "x1", "A", "bad", None, None), ("8", None, "A", "2024-01-01", "N", "1")], CAPTURES)
    budget = spark.createDataFrame([("007", "9", "T-1-Uno-Dos", "5", "R1"), ("007", "9", "T-1-Uno-Dos", "5", "R1"),
                                    ("x1", None, "plain", None, None), (None, "8", "T-2-Z", "1", "R1")], BUDGET)
    got = rows(RC.matched_payments(captures, budget), "id", "nit_payer", "third_name", "package_id")
    assert ("97", "9", "Uno-Dos", "007") in got and len(got) == 2


def test_payments_are_dealt_by_rows_not_bytes(spark, monkeypatch):
    """Repeated texts pack into few bytes; a task still gets few packages."""
    monkeypatch.setattr(RC, "PACKAGE_ROWS", 100)
    n = F.col("id").cast("string")
    captures = spark.range(4000).select(F.lit("9").alias("id_number"), n.alias("capture_id"), *[F.lit("x").alias(c) for c in ("account_no", "collection_date", "payer_name", "value")])
    budget = spark.range(4000).select(n.alias("invoice"), *[F.lit("x").alias(c) for c in ("third_id", "third_name", "value", "code")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = RC.matched_payments(captures, budget).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in per_task) == 4000 and max(r["count"] for r in per_task) < 300


def test_reconciliation_load_defaults_and_checks(spark):
    captures = spark.createDataFrame([("9", "007", "A", "2024-03-05", "N", "5"), ("9", "008", "A", "2024-01-05", "N", "6")], CAPTURES)
    budget = spark.createDataFrame([("007", "9", "T-1-Uno", "5", "R1"), ("008", "", "T-1-Dos", "6", "R9")], BUDGET)
    codes = spark.createDataFrame([("R1", "b"), ("R1", "a")], "code string, name string")
    accounts = spark.createDataFrame([("A", 2024, 2, "febrero"), ("A", 2023, 12, "x")], "account string, year int, month int, name string")
    pairs = {"check_nit": ("nit_payer", "nit_beneficiary"), "check_value": ("movement_value", "captured_value")}
    got = RC.reconciliation_load(captures, budget, codes, accounts, pairs, {"nit_captured": "nit_payer"})
    assert rows(got, "id", "month", "check_nit", "check_value", "val_check", "concept", "account_name", "nit_captured") == [
        ("97", "MARZO", "CORRECTO", "CORRECTO", "INVALIDO", "a", "febrero", "9"),
        ("98", "ENERO", "INCORRECTO", "CORRECTO", "INVALIDO", None, None, "9")]


def test_chain_keeps_unmatched_rows_until_the_filter(spark):
    facts = spark.createDataFrame([("R1", "PAGO TASA"), ("R2", "PAGO TASA"), (None, "TASA"), ("R3", "OTRO")], "code string, text string")
    groups = spark.createDataFrame([("R1", 1), ("R3", 3), (None, 7)], "code string, g int")
    types = spark.createDataFrame([("R1", 1, "Tasa"), ("R1", 2, "Pago"), ("R3", 3, "Tasa"), ("R3", 3, "")], "code string, g int, name string")
    out = RC.dimension_chain(facts, [(groups, [("code", "code")], {"g": "g"}), (types, [("g", "g"), ("code", "code")], {"name": "name"})])
    assert rows(out, "code", "g", "name", "levels_matched") == sorted([
        ("R1", 1, "Tasa", 2), ("R2", None, None, 0), (None, None, None, 0), ("R3", 3, "Tasa", 2), ("R3", 3, "", 2)], key=repr)
    assert rows(RC.mentioned(out, "name", "text"), "code", "name") == [("R1", "Tasa")]


def test_log_ids_follow_the_mark_and_a_replay_replaces(spark, tmp_path):
    path = f"{tmp_path}/log"
    batch = lambda *ops: spark.createDataFrame([(o,) for o in ops], "op string")
    entry = lambda df, **kw: CD.log_entries(df, ["op"], F.col("op"), "orders", AS_OF, **kw)
    CD.append_log(entry(batch("B", "A", "A")), path, 1)
    CD.append_log(entry(batch("C", "A")), path, 2)
    log = CD.append_log(entry(batch("C", "A", "D"), details={"source_file": F.lit("f.csv")}), path, 2)
    assert rows(log, "log_id", "batch_id", "operation_type", "record_count", "source_file") == [
        (1, 1, "A", 2, None), (2, 1, "B", 1, None), (3, 2, "A", 1, "f.csv"), (4, 2, "C", 1, "f.csv"), (5, 2, "D", 1, "f.csv")]
    assert set(CD.LOG_DETAILS) < set(log.columns)
    with pytest.raises(ValueError):
        entry(batch("A"), details={"colour": F.lit("red")})


def _files(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns
            for at, _, names in os.walk(path) if "bucket=" in at for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    SK.write_buckets(spark.range(200).select(F.col("id").cast("int").alias("id"), F.lit("old").alias("v")), path, ["id"], 16)
    before = _files(path)
    incoming = spark.createDataFrame([(5, "new")], "id int, v string")
    for _ in range(2):  # running it again changes nothing
        SK.upsert_buckets(incoming, path, ["id"], 16)
        got = spark.read.parquet(path)
        assert got.count() == 200 and rows(got.filter("v = 'new'"), "id", "v") == [(5, "new")]
    after = _files(path)
    assert len({os.path.dirname(f) for f in after}) == 16
    changed = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(changed) == 1 and all(after[f] == before[f] for f in before.keys() & after.keys())


def test_upsert_adds_rows_takes_null_keys_and_refuses_repeats(spark, tmp_path):
    path = f"{tmp_path}/t"
    SK.write_buckets(spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string"), path, ["id"], 4)
    SK.upsert_buckets(spark.createDataFrame([(None, "c"), (2, "d")], "id int, v string"), path, ["id"], 4)
    want = sorted([(1, "a"), (None, "c"), (2, "d")], key=repr)
    assert rows(spark.read.parquet(path), "id", "v") == want
    with pytest.raises(ValueError):
        SK.upsert_buckets(spark.createDataFrame([(3, "x"), (3, "y")], "id int, v string"), path, ["id"], 4)
    SK.upsert_buckets(spark.createDataFrame([], "id int, v string"), path, ["id"], 4)
    assert rows(spark.read.parquet(path), "id", "v") == want


def test_session_ids_that_are_no_uuid_become_null(spark):
    text = ["{0e984725-c51c-4bf4-9960-e1c80e27aba0}", "0E984725-C51C-4BF4-9960-E1C80E27ABA0", "0e984725c51c4bf49960e1c80e27aba0", "", None, "x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", C.to_uuid("t").alias("u"))
    assert [r["u"] for r in got.orderBy("i").collect()] == ["0E984725-C51C-4BF4-9960-E1C80E27ABA0"] * 2 + [None] * 4


def test_key_candidates_share_one_scan(spark, tmp_path):
    path = f"{tmp_path}/k"
    spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, 2, "a"), (1, None, "b")], "x int, y int, z string").write.parquet(path)
    keys = [("p", "PRIMARY KEY", ["x", "y"]), ("u", "UNIQUE", ["z", "x", "y"]), ("v", "UNIQUE", ["y", "x"]), ("w", "UNIQUE INDEX", ["z"])]
    got = KY.verify_candidates(spark.read.parquet(path), keys)
    assert rows(got, "key_name", "n_rows", "n_distinct", "is_unique") == [
        ("p", 4, 3, False), ("u", 4, 4, True), ("v", 4, 3, False), ("w", 4, 2, False)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    empty = KY.verify_candidates(spark.read.parquet(path).filter("false"), keys)
    assert {(r["n_distinct"], r["is_unique"]) for r in empty.collect()} == {(0, None)}


def test_column_report_joins_profile_type_and_kind(spark):
    df = spark.createDataFrame([(1, "a@b.co", None), (2, None, None), (3, "c@d.org", None)], "k int, mail string, void string")
    got = {r["column_name"]: r for r in PR.column_report(df, ["k"]).collect()}
    assert (got["mail"]["data_type"], got["mail"]["inferred_kind"], got["mail"]["null_count"]) == ("string", "email", 1)
    assert (got["k"]["data_type"], got["void"]["inferred_kind"], got["void"]["distinct_count"]) == ("int", "unknown", 0)
