from hypothesis import given, settings
from hypothesis import strategies as st

from gridload.operators import dedup as D
from gridload.operators import incremental as I

SCHEMA = "k string, o int, v string"


def test_keep_first_last_none_with_null_keys(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), (None, 3, "n1"), (None, 4, "n2"), ("b", 5, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(r.v for r in D.dedup(df, ["k"], ["o"], "first").collect())
    last = sorted(r.v for r in D.dedup(df, ["k"], ["o"], "last").collect())
    none = sorted(r.v for r in D.dedup(df, ["k"], ["o"], False).collect())
    assert first == ["n1", "x", "z"]
    assert last == ["n2", "y", "z"]
    assert none == ["z"]


def test_summary_counts_null_groups_as_duplicates_but_not_as_groups(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 3, "c"), ("k", 4, "d"), ("u", 5, "e")],
                               SCHEMA)
    s = D.duplicate_summary(df, ["k"]).first()
    assert (s.total_rows, s.duplicate_count, s.unique_count, s.total_groups) == (5, 4, 1, 1)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 1000)), min_size=1,
                max_size=30, unique_by=lambda t: t[1]))
def test_dedup_keeps_one_row_per_key(spark, rows):
    df = spark.createDataFrame([(k, o, str(o)) for k, o in rows], SCHEMA)
    out = D.dedup(df, ["k"], ["o"], "first").collect()
    keys = [r.k for r in out]
    assert len(keys) == len(set(keys)) == len({k for k, _ in rows})
    best = {}
    for k, o in rows:
        best[k] = min(best.get(k, o), o)
    assert {(r.k, r.o) for r in out} == set(best.items())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", None]), max_size=20),
       st.lists(st.sampled_from(["a", "c", None]), max_size=10))
def test_new_plus_existing_is_input(spark, incoming, target):
    inc = spark.createDataFrame([(k, i, "") for i, k in enumerate(incoming)], SCHEMA)
    tgt = spark.createDataFrame([(k, i, "") for i, k in enumerate(target)], SCHEMA)
    new = {r.o for r in I.filter_new(inc, tgt, ["k"]).collect()}
    old = {r.o for r in I.existing(inc, tgt, ["k"]).collect()}
    assert new | old == set(range(len(incoming))) and not (new & old)
    flags = {r.o: r.exists_in_db for r in I.flag_existing(inc, tgt, ["k"]).collect()}
    assert {o for o, f in flags.items() if f} == old


def test_missing_key_column_raises(spark):
    df = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    import pytest

    with pytest.raises(ValueError):
        I.filter_new(df, df, ["nope"])


def test_collation_and_no_key_warning(spark):
    import warnings

    inc = spark.createDataFrame([("ABC", 1, ""), ("abc ", 2, ""), ("x", 3, "")], SCHEMA)
    tgt = spark.createDataFrame([("abc", 9, "")], SCHEMA)
    assert sorted(r.o for r in I.filter_new(inc, tgt, ["k"]).collect()) == [1, 2, 3]
    assert sorted(r.o for r in I.filter_new(inc, tgt, ["k"], collation="UTF8_LCASE").collect()) == [2, 3]
    assert sorted(r.o for r in I.filter_new(inc, tgt, ["k"], collation="UNICODE_CI_RTRIM").collect()) == [3]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert I.filter_new(inc, tgt, []).count() == 3
        assert any("every incoming row" in str(x.message) for x in w)


def test_repeated_values_prefilter_is_exact(spark):
    rows = [("t1", 1, "same text"), ("t2", 2, "same text"), ("t3", 3, "other"), ("t4", 4, None),
            ("t5", 5, None), ("t6", 6, "unique")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = sorted((r.o, r.dup_count) for r in D.repeated_values(df, "v").collect())
    plain = sorted((r.o, r.dup_count) for r in D.repeated_values(df, "v", prefilter=False).collect())
    assert got == plain == [(1, 2), (2, 2), (4, 2), (5, 2)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])), min_size=1, max_size=20),
       st.lists(st.tuples(st.sampled_from(["a", None]), st.sampled_from([1, None])), max_size=8))
def test_multi_key_salted_joins_match_brute_force(spark, incoming, target):
    inc = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(incoming)], "a string, b int, i int")
    tgt = spark.createDataFrame([(a, b, 0) for a, b in target], "a string, b int, i int")
    tset = set(target)
    want_new = {i for i, t in enumerate(incoming) if t not in tset}
    assert {r.i for r in I.filter_new(inc, tgt, ["a", "b"]).collect()} == want_new
    assert {r.i for r in I.existing(inc, tgt, ["a", "b"]).collect()} == set(range(len(incoming))) - want_new
    flags = {r.i: r.exists_in_db for r in I.flag_existing(inc, tgt, ["a", "b"]).collect()}
    assert flags == {i: (i not in want_new) for i in range(len(incoming))}
