import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from gridload.operators import profile as PR


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200))
def test_exact_quantiles_match_pandas(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.prob: r.value for r in PR.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], buckets=4).collect()}
    s = pd.Series(values)
    for q in [0.0, 0.25, 0.5, 0.75, 1.0]:
        assert np.isclose(got[q], s.quantile(q), rtol=1e-9, atol=1e-6)


def test_quantiles_with_a_hot_value(spark):
    vals = [5.0] * 300 + list(range(100))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r.prob: r.value for r in PR.exact_quantiles(df, "x", [0.1, 0.5, 0.9]).collect()}
    s = pd.Series(vals, dtype=float)
    for q, v in got.items():
        assert np.isclose(v, s.quantile(q))


def test_profile_counts_nulls_and_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "a int, b string")
    p = {r.column_name: r for r in PR.column_profile(df).collect()}
    assert (p["a"].null_count, p["a"].distinct_count) == (0, 2)
    assert (p["b"].null_count, p["b"].distinct_count, p["b"].null_warning) == (2, 1, True)


def test_approx_options(spark, small_dir):
    o = spark.read.parquet(f"{small_dir}/orders.parquet")
    exact = {r.column_name: r.distinct_count for r in PR.column_profile(o, ["o_orderstatus"]).collect()}
    approx = {r.column_name: r.distinct_count for r in PR.column_profile(o, ["o_orderstatus"], approx=True).collect()}
    assert exact == approx == {"o_orderstatus": 3}
    a = PR.numeric_profile(o, "o_totalprice", approx=True).first()
    e = PR.numeric_profile(o, "o_totalprice").first()
    assert abs(a.q1 - e.q1) / e.q1 < 0.01 and a.n_values == e.n_values
