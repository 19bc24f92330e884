"""Plan-shape checks for the properties the operators rely on at scale."""

from gridload.operators import dedup as D
from gridload.operators import incremental as I
from gridload.operators import profile as PR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_limits_before_the_shuffle(spark, small_dir):
    li = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    p = plan(D.dedup(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "first"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_keep_none_and_profiles_aggregate_partially(spark, small_dir):
    li = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    none = plan(D.dedup(li, ["l_orderkey"], ["l_partkey"], False))
    assert "WindowGroupLimit" in none and "SortAggregate" not in none and none.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan(PR.column_profile(li, ["l_returnflag", "l_linestatus"]))
    assert "partial_sum" in plan(D.duplicate_summary(li, ["l_orderkey"]))


def test_new_record_filter_prunes_and_pushes_down(spark, small_dir):
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{small_dir}/orders.parquet")
    t = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    p = plan(I.filter_new(o.select("o_orderkey", "o_totalprice"), t, ["o_orderkey"]))
    assert "LeftAnti" in p
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_single_key_join_salts_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    t = spark.createDataFrame([(3, 0)], "k int, v int")
    out = I.filter_new(df, t, ["k"])
    p = plan(out)
    assert "_salt" in p and p.count("LeftAnti") == 1  # one join; rows with a null key are spread over salts
    assert sorted(r.v for r in out.collect()) == [1, 2]
    t2 = spark.createDataFrame([(None, 0)], "k int, v int")
    assert sorted(r.v for r in I.filter_new(df, t2, ["k"]).collect()) == [3]
