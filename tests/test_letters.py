"""Candidates by common letters: none that can reach the floor is lost, and no plan pairs all names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridload.operators import match as M
from gridload.operators.letters import common_needed, pairs_above


def words(seed, n, letters="abcdeé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(n)})


def tables(spark, left, right):
    return (spark.createDataFrame([(x, x) for x in left], "name string, key string"),
            spark.createDataFrame([(x, x) for x in right], "target string, tkey string"))


@pytest.mark.parametrize("floor", [95, 70, 50, 20])
def test_no_pair_above_the_floor_is_lost(spark, floor):
    left, right = words(floor, 70), words(floor + 1, 50)
    ldf, rdf = tables(spark, left, right)
    for bound, score in ((lambda *x: M._indel_bound(*x) + 0.5, M.ratio),
                         (lambda *x: 0.8 * M._indel_bound(*x) + 0.2 * M._partial_bound(*x) + 0.5, lambda a, b: 0.8 * M.ratio(a, b) + 0.2 * M.partial_ratio(a, b))):
        got = {(r.name, r.target) for r in pairs_above(ldf, rdf, bound, floor).collect()}
        want = {(a, b) for a in left for b in right if a and b and score(a, b) >= floor}
        assert want <= got
        if floor >= 70:
            assert len(got) < len(left) * len(right) / 3


def test_bounds_hold(spark):
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        c = sum(min(a.count(x), b.count(x)) for x in set(a))
        n = float(len(a)), float(len(b)), float(c), min, max
        assert M.ratio(a, b) <= M._indel_bound(*n) + 0.5 and M.partial_ratio(a, b) <= M._partial_bound(*n) + 0.5


def test_common_needed_without_any_partner():
    need, low, high = common_needed(lambda n, m, c, least, most: M._indel_bound(n, m, c, least, most), 101, 5)
    assert low == [1] * 6 and high == [0] * 6 and need == [0] * 6


def test_plan_has_equi_joins_only(spark):
    ldf, rdf = tables(spark, ["abc", "abd"], ["abc"])
    plan = pairs_above(ldf, rdf, M._indel_bound, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    for join in re.findall(r"Join (\w+), (.*)", plan):
        assert " = " in join[1]


def test_empty_lists_and_null_names(spark):
    ldf = spark.createDataFrame([(1, None), (2, "customer"), (3, "")], "lid int, lname string")
    rdf = spark.createDataFrame([("customers",), (None,)], "target string")
    got = {r.left_id: r.target_name for r in M.weighted_link(ldf, rdf, "lid", "lname", "target").collect()}
    assert got == {1: None, 2: "customers", 3: None}
    assert M.weighted_link(ldf.limit(0), rdf, "lid", "lname", "target").count() == 0
    assert M.weighted_link(ldf, rdf.limit(0), "lid", "lname", "target").filter("target_name is not null").count() == 0
    assert M.alternatives(ldf, rdf.limit(0), "lid", "lname", "target").count() == 0


def test_alternatives_over_thousands_of_names(spark):
    rng = random.Random(8)
    vocabulary = words(2, 60, "abcdefgh")
    left = sorted({" ".join(rng.sample(vocabulary, 2)) for _ in range(2000)})
    right = sorted({" ".join(rng.sample(vocabulary, 2)) for _ in range(40)})
    ldf = spark.createDataFrame([(i, x) for i, x in enumerate(left)], "lid int, lname string")
    rdf = spark.createDataFrame([(x,) for x in right], "target string")
    got = {}
    for r in M.alternatives(ldf, rdf, "lid", "lname", "target").collect():
        got.setdefault(r.left_id, []).append((r["rank"], r.target_name, r.score))
    for i in rng.sample(range(len(left)), 150):
        scored = sorted((-M.token_sort_ratio(left[i], t), t) for t in right)[:3]
        assert sorted(got.get(i, [])) == [(k + 1, t, -s) for k, (s, t) in enumerate(scored) if -s >= 50]


def test_a_letter_that_all_names_hold_is_dealt_to_many_tasks(spark, monkeypatch):
    from gridload.operators import letters as L

    for name, value in (("SIDE", 16), ("PAIRS", 100), ("NAMES", 50)):
        monkeypatch.setattr(L, name, value)
    left, right = words(1, 120, "ab"), words(2, 60, "ab")
    ldf, rdf = tables(spark, left, right)
    found = pairs_above(ldf, rdf, lambda *x: M._indel_bound(*x) + 0.5, 60)
    got = found.select("name", "target", F.spark_partition_id().alias("task")).collect()
    pairs = [(r.name, r.target) for r in got]
    assert len(pairs) == len(set(pairs))
    assert {(a, b) for a in left for b in right if a and b and M.ratio(a, b) >= 60} <= set(pairs)
    per_task = Counter(r.task for r in got)
    assert len(per_task) > 10 and max(per_task.values()) < len(pairs) / 4


def test_letters_beyond_the_known_ones_keep_all_pairs(spark, monkeypatch):
    from gridload.operators import letters as L

    monkeypatch.setattr(L, "KNOWN", 2)
    left, right = words(3, 60), words(4, 60)
    ldf, rdf = tables(spark, left, right)
    got = {(r.name, r.target) for r in pairs_above(ldf, rdf, lambda *x: M._indel_bound(*x) + 0.5, 70).collect()}
    assert {(a, b) for a in left for b in right if a and b and M.ratio(a, b) >= 70} <= got
