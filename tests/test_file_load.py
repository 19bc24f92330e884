"""Files of unlike headers, and the update that reads the old image of a row."""

import os

from pyspark.sql import functions as F

from gridload.operators import recon as RC
from gridload.operators import rules as R
from gridload.plans import pipelines as PL
from gridload.session import scratch_path
from gridload.sources import exports as EX


def put(root, name, text):
    path = os.path.join(root.removeprefix("file:"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_files_of_unlike_headers(spark):
    root = scratch_path(spark, "unlike")
    put(root, "a/one.csv", "id,name!,when\n1,\"x, y\",2024-01-02\n2,\"two\nlines\",\n")
    put(root, "a/two words+plus.CSV", "﻿name!,id,extra\nz,3,q\n,,\n")
    put(root, "b/short.csv", "id\n4\nnope\n")
    put(root, "b/header only.csv", "id,name!\n")
    put(root, "b/twice.csv", "id,name!,name\n1,2,3\n")
    put(root, "b/empty.csv", "")
    put(root, "b/notes.txt", "id\n9\n")
    put(root, "b/large.csv", "id\n" + "5\n" * 500)
    rows, files = EX.read_unlike(spark, root, max_bytes=900)
    got = {f.file_name: (f.admitted, f.reason) for f in files.collect()}
    assert got == {"one.csv": (True, None), "two words+plus.CSV": (True, None), "short.csv": (True, None), "header only.csv": (True, None),
                   "twice.csv": (False, "repeated column name"),  # Spark lists no file of zero bytes
                   "notes.txt": (False, "unsupported extension .txt"), "large.csv": (False, "file too large")}
    assert set(rows.columns) == {"id", "name", "when", "extra", "source_file", "sheet_row"}
    assert sorted((r.id or "", r.name or "", r.sheet_row) for r in rows.collect()) == [
        ("", "", 3), ("1", "x, y", 2), ("2", "two\nlines", 3), ("3", "z", 2), ("4", "", 2), ("nope", "", 3)]
    load = PL.file_load(spark, root, {"id": {"target": "key", "confidence": 1}, "name!": {"target": "label", "confidence": 1}},
                        {"key": "int"}, [R.ColumnSpec("key", "key", "INTEGER")], max_bytes=900)
    assert sorted((r.key or 0, r.label or "") for r in load.rows.collect()) == [(1, "x, y"), (2, "two\nlines"), (3, "z"), (4, "")]
    counts = load.counts.first().asDict()
    assert counts.pop("issues") >= 1
    assert counts == {"files_admitted": 4, "files_rejected": 3, "layouts": 4, "rows_read": 6, "rows_kept": 4, "rows_skipped": 2}
    assert {os.path.basename(r.source_file) for r in load.issues.filter("value = 'nope'").collect()} == {"short.csv"}


def test_folder_without_admitted_files(spark):
    root = scratch_path(spark, "none")
    put(root, "x.txt", "a\n")
    load = PL.file_load(spark, root, {"a": {"target": "b", "confidence": 1}}, {"b": "int"})
    assert load.rows.count() == 0 and load.counts.first()["files_rejected"] == 1 and load.counts.first()["rows_read"] == 0


def test_update_reads_the_old_image_and_one_match(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (2, 20, "b"), (3, 30, None)], "id int, v int, k string")
    dim = spark.createDataFrame([("a", "second"), ("a", "first"), ("c", "other")], "key string, name string")
    out = RC.update_from(rows, {"v": F.col("id"), "id": F.col("v"), "found": F.col("d.name")}, [("d", dim, [(F.col("k"), "key")], ["name"])])
    assert sorted(map(tuple, out.collect()), key=str) == [(10, 1, "a", "first"), (20, 2, "b", None), (20, 2, "b", None), (30, 3, None, None)]
    assert out.columns == ["id", "v", "k", "found"]


def test_second_update_lags_one_behind(spark, small_dir):
    from gridload.plans.catalog import QUERIES

    first = {r["val_check"]: r["count"] for r in QUERIES["j5_code_join"](spark, small_dir).groupBy("val_check").count().collect()}
    assert set(first) == {"INVALIDO"}
    second = QUERIES["p16_second_update"](spark, small_dir)
    rights = " AND ".join(f"{c} = 'CORRECTO'" for c in ("check_nit", "check_value", "check_id"))
    assert second.filter(f"val_check = 'VALIDADO' AND NOT ({rights})").count() > 0
    assert second.filter(f"val_check = 'INVALIDO' AND {rights}").count() > 0
    assert second.filter(f"val_check = 'VALIDADO' AND {rights}").count() > 0
    assert second.filter("concept IS NULL").count() > 0 and second.filter("concept LIKE '% a'").count() > 0
