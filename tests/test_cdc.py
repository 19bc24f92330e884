from gridload.operators import cdc as CD

S = "id int, a string, b double"


def test_diff_null_semantics(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, None, 3.0)], S)
    new = spark.createDataFrame([(1, "y", 1.0), (2, None, 2.0), (3, "z", 3.0)], S)
    d = {(r.record_id, r.column_name, r.old_value, r.new_value) for r in CD.diff(old, new, "id", ["a", "b"]).collect()}
    assert d == {("1", "a", "x", "y"), ("3", "a", None, "z")}


def test_classify_replays_old_to_new(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)], S)
    new = spark.createDataFrame([(1, "x", 1.0), (2, "Y", 2.0), (4, "w", 4.0)], S)
    c = {r.id: r.change_type for r in CD.classify(old, new, "id", ["a", "b"]).collect()}
    assert c == {1: "UNCHANGED", 2: "UPDATE", 3: "DELETE", 4: "INSERT"}


def test_assign_ids_dense_in_order(spark):
    df = spark.range(0, 500).selectExpr("id * 7 % 500 AS k").repartition(7)
    out = sorted((r.k, r.new_id) for r in CD.assign_ids(df, ["k"], 100, "new_id").collect())
    assert [i for _, i in out] == list(range(101, 601))


def test_row_positions_follow_file_order(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/orders.parquet").select("o_orderkey")
    assert all(r.o_orderkey == r.row_position for r in CD.row_positions(df).collect())


def test_touch_marks_only_changed_records(spark):
    from datetime import datetime

    from gridload.operators import cdc as CD

    new = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ '2020-01-01'), (2, 'b', NULL), (3, 'c', TIMESTAMP_NTZ '2021-01-01'), (4, NULL, NULL) t(id, v, modified_date)")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y")], "id int, v string")
    got = {r.id: r.modified_date for r in CD.touch_modified(new, old, "id", "2025-01-01 00:00:00").collect()}
    assert got == {1: datetime(2020, 1, 1), 2: datetime(2025, 1, 1), 3: datetime(2021, 1, 1), 4: datetime(2025, 1, 1)}
