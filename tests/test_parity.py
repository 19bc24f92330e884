"""Parity with the pandas behaviours the loader relies on (written against pandas itself)."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from gridload.operators import dedup as D

keys = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from([1, 2, None])),
                min_size=1, max_size=25)


def frames(spark, rows):
    pdf = pd.DataFrame([(k1, k2, i) for i, (k1, k2) in enumerate(rows)], columns=["k1", "k2", "pos"])
    sdf = spark.createDataFrame([(k1, k2, i) for i, (k1, k2) in enumerate(rows)],
                                "k1 string, k2 int, pos int")
    return pdf, sdf


@settings(max_examples=12, deadline=None)
@given(keys, st.sampled_from(["first", "last", False]))
def test_dedup_matches_pandas_drop_duplicates(spark, rows, keep):
    pdf, sdf = frames(spark, rows)
    want = sorted(pdf.drop_duplicates(subset=["k1", "k2"], keep=keep)["pos"].tolist())
    got = sorted(r.pos for r in D.dedup(sdf, ["k1", "k2"], ["pos"], keep).collect())
    assert got == want


@settings(max_examples=12, deadline=None)
@given(keys)
def test_duplicate_summary_matches_pandas(spark, rows):
    pdf, sdf = frames(spark, rows)
    mask = pdf.duplicated(subset=["k1", "k2"], keep=False)
    groups = [g for _, g in pdf[mask].groupby(["k1", "k2"]) if len(g) > 1]  # dropna=True, as the report
    s = D.duplicate_summary(sdf, ["k1", "k2"]).first()
    assert s.duplicate_count == int(mask.sum())
    assert s.unique_count == len(pdf) - int(mask.sum())
    assert s.total_groups == len(groups)
    listed = {(r.k1, r.k2): (r.dup_count, r.first_row, r.last_row)
              for r in D.duplicate_groups(sdf, ["k1", "k2"], "pos").collect()}
    assert listed == {(g.k1.iloc[0], int(g.k2.iloc[0])): (len(g), int(g.pos.min()), int(g.pos.max()))
                      for g in groups}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 3)), min_size=1, max_size=20))
def test_full_duplicate_rows_match_pandas(spark, rows):
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    sdf = spark.createDataFrame(rows, "a string, b long")
    assert D.full_duplicate_count(sdf).first().duplicate_rows == int(pdf.duplicated().sum())
