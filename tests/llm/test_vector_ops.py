"""Whitening, n-gram join and hard negatives against brute force on small tables with odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridload.llm import gram_join, negatives, whitening

INF, NAN = float("inf"), float("nan")
#: Extra columns named like the operators' own.
VECS = "vec_id long, embedding array<double>, label int, id long, vec string, n long, whitened int, slab int, anchor string, at int"
DOCS = "doc_id long, text string, node string, n int, bucket string, comp string, row int, th int, items int"


def vecs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], VECS)


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS)


# ---- whitening ----------------------------------------------------------------------------------------

def test_polynomial_and_roots_are_exact(spark):
    rng = random.Random(3)
    b = [[rng.randrange(-9, 10) for _ in range(6)] for _ in range(4)]  # rank 4
    a = [[sum(r[i] * r[j] for r in b) for j in range(6)] for i in range(6)]
    poly = whitening.characteristic_polynomial(spark, a)
    assert poly[6] == 1 and poly[:2] == [0, 0] and poly[5] == -sum(a[i][i] for i in range(6))
    want = np.linalg.eigvalsh(np.array(a, float))[::-1]
    assert np.allclose([float(r) for r in whitening.largest_roots(poly, 9)], want[:4], rtol=1e-12)
    # (x - 5)^3 (x - 2) x: equal and exact roots
    poly = [0, 250, -275, 105, -17, 1]
    assert [round(float(r), 12) for r in whitening.largest_roots(poly, 5)] == [5, 5, 5, 2]


def test_gram_is_exact_for_huge_entries():
    x = np.array([[2 ** 62, -2 ** 62, 3], [2 ** 61 + 1, 7, -1], [-5, 2 ** 40 + 3, 0]])
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert whitening.gram(x).tolist() == want


def test_whiten_against_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)) * [1, 2, 3, 4, 5, 6]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(None, rows[0][1], None), (7, rows[1][1], 1)]  # a null id and a repeated id count
    odd = [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (902, [NAN] * 6, 0), (903, [INF] * 6, 0), (904, [1.0], 0), (905, [], 0)]
    out, fit, error = whitening.whiten(vecs(spark, rows + odd), components=4)
    got = out.collect()
    assert len(got) == len(rows) == fit.n and error < 1e-9
    y = np.floor(1024 * np.array([r[1] for r in rows]))
    value, vector = np.linalg.eigh(np.cov(y.T, bias=True))
    assert np.allclose(fit.values, value[::-1][:4], rtol=1e-12) and np.allclose(fit.explained, value[::-1][:4] / value.sum(), rtol=1e-12)
    assert np.allclose(np.abs(fit.vectors @ vector[:, ::-1][:, :4]), np.eye(4), atol=1e-9)
    n, s = len(y), y.sum(axis=0)
    want = sorted((sum(int(n * c - t) ** 2 for c, t in zip(v, s)), tuple(np.round((v - s / n) @ fit.vectors.T / np.sqrt(fit.values), 6))) for v in y)
    assert sorted((int(r.deviation), tuple(np.round(r.whitened, 6))) for r in got) == [(d, pytest.approx(w, abs=2e-6)) for d, w in want]


def test_whiten_equal_roots_and_missing_components(spark):
    rows = [(i, [s if j == d else 0.0 for j in range(3)], 0) for i, (d, s) in enumerate(itertools.product(range(3), (1.0, -1.0)))]
    out, fit, error = whitening.whiten(vecs(spark, rows))  # three equal roots
    assert len(fit.values) == 3 and np.allclose(fit.vectors @ fit.vectors.T, np.eye(3), atol=1e-12) and error < 1e-9
    line = [(i, [float(i), 2.0 * i], 0) for i in range(5)]  # rank 1
    assert len(whitening.whiten(vecs(spark, line))[1].values) == 1
    for none in ([], [(1, [1.0, 2.0], 0)], [(1, [3.0], 0), (2, [3.0], 0)], [(1, None, 0)], [(1, [], 0)]):
        out, fit, error = whitening.whiten(vecs(spark, none))
        assert out.count() == 0 and error is None and out.columns == ["id", "deviation", "whitened"]
    big = whitening.whiten(vecs(spark, [(i, [1e300 * (-1) ** i, float(i)], 0) for i in range(4)]))[0].collect()
    assert len(big) == 4 and all(len(r.whitened) == 2 for r in big)


# ---- n-gram join --------------------------------------------------------------------------------------

def sets_of(text, k):
    w = [x for x in (text or "").translate(str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def joined(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append((doc is None, doc))
    return sorted(((doc is None, doc), len(sets[i]), min(least[find(i)])[1]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("percent,levels", [(80, (1, 3)), (80, (32,)), (60, (0,)), (80, (0,)), (40, (1, 4)), (80, (0, 1, 4))])
def test_gram_join_against_all_pairs(spark, percent, levels):
    rng = random.Random(percent + len(levels))
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 30, 60)))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            at = rng.randrange(len(w) + 1)
            w[at: at + rng.choice((0, 1))] = [rng.choice(words)] * rng.choice((0, 1))
        rows.append((1000 - i, " ".join(w)))
    rows += [(5, None), (6, ""), (7, " \t"), (None, rows[0][1]), (None, None), (8, "solo"), (9, "SOLO"), (9, "solo"), (10, "x " * 3000), (11, "x " * 2999 + "y")]
    got = gram_join.gram_join(docs(spark, rows), k=2, percent=percent, levels=levels).collect()
    assert sorted(((r.id is None, r.id), r.n, r.component) for r in got) == joined(rows, 2, percent)


def test_gram_join_large_group_of_unlinked_members(spark):
    shared = [f"s{i}" for i in range(40)]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample(shared, 12))) for i in range(300)]
    rows += [(1000 + i, " ".join([*shared, f"own{i % 3}"])) for i in range(60)]
    got = gram_join.gram_join(docs(spark, rows), k=1, levels=(2, 8)).collect()
    assert sorted(((False, r.id), r.n, r.component) for r in got) == joined(rows, 1, 80)


def test_gram_join_guarantee_holds_in_every_band():
    for percent, classes, band in itertools.product((40, 60, 80, 95), (2, 3, 4), range(1, 14)):
        parts = gram_join.parts_of(band, percent, classes)
        loss = sum((k - 1) * n for k, n in parts.values())
        smallest = gram_join._least_common(1 << band, percent)
        assert loss < max(1, gram_join._least_common(smallest, percent))


def test_gram_join_empty_table(spark):
    assert gram_join.gram_join(docs(spark, [])).count() == 0


# ---- hard negatives -----------------------------------------------------------------------------------

def mined(rows, anchors, k=5, m=10, scale=256, low=30, high=90):
    rows = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    first = {}
    for i, v, lab in rows:
        if i in anchors and (i not in first or (lab, v) < first[i]):
            first[i] = (lab, v)
    for a, (lab, v) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, ub) for i, u, ub in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            hard = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, at + 1, h[1], -s, -h[0]) for at, h in enumerate(hard[:m])]
    return sorted(out)


def random_vectors(n, seed, levels=9):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-levels, levels + 1) / 8 for _ in range(3)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 9])
def test_hard_negatives_against_all_pairs(spark, levels, monkeypatch):
    monkeypatch.setattr(negatives, "SLAB", 64)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rows = random_vectors(400, levels, levels)  # at one level: 27 vectors, so ties everywhere
    rows += [(None, [1.0, 1.0, 1.0], 1), (500, None, 1), (501, [1.0, NAN, 0.0], 1), (502, [1.0, None, 0.0], 1), (503, [INF, 0.0, 0.0], 2),
             (504, [1.0, 1.0, 1.0], None), (505, [1.0], 1), (506, [], 1), (20, [1.0, 0.5, 0.5], 1)]
    got = negatives.mine(vecs(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows, set(range(0, 600, 20)))


def test_hard_negatives_one_label_and_equal_vectors(spark):
    same = [(i, [1.0, 0.5, 0.25], 0) for i in range(300)]
    assert negatives.mine(vecs(spark, same), F.col("vec_id") < 3).count() == 0
    rows = same + [(1000 + i, [0.5, 0.25, 0.125], 1) for i in range(40)]
    got = negatives.mine(vecs(spark, rows), F.col("vec_id") < 3).collect()
    assert sorted(map(tuple, got)) == mined(rows, {0, 1, 2})


def test_hard_negatives_empty_and_huge(spark):
    for none in ([], [(1, None, 1)], [(1, [], 0)], [(1, [1.0, 2.0, 3.0], 0)]):
        assert negatives.mine(vecs(spark, none), F.lit(True)).count() == 0
    rows = [(i, [1e5 * i, 2e5, -1e5], i % 2) for i in range(60)]
    assert sorted(map(tuple, negatives.mine(vecs(spark, rows), F.col("vec_id") < 4).collect())) == mined(rows, {0, 1, 2, 3})
    assert negatives.mine(vecs(spark, [(i, [1e300, 1e300], i % 2) for i in range(9)]), F.col("vec_id") < 2).count() >= 0


def test_hard_negatives_search_prunes():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(-500, 500, (4096, 1)), axis=0)
    x = np.hstack([x, rng.integers(-5, 5, (4096, 2))]).astype(np.float64)
    tree = negatives._Tree(np.arange(4096), np.zeros(4096, np.int64), x)
    opened = []
    best = negatives._Best(1, -(1 << 63), (1 << 63) - 1, -(1 << 63), (1 << 63) - 1, 5)
    add = best.add
    best.add = lambda s, i: (opened.append(1), add(s, i))
    a = np.array([100.0, 1.0, 1.0])
    least, most = tree.intervals(a[None])
    negatives._best_first(tree, a, -1, 0, True, [best], least[0], most[0])
    want = np.lexsort((np.arange(4096), -(x @ a)))[:5]
    assert best.id.tolist() == want.tolist() and len(opened) < tree.leaves / 2


def test_gram_join_counts_in_few_passes(spark, monkeypatch):
    """Texts that share most of their words: each counting turn is a pass over all texts, so there must be few."""
    shared, rng = [f"s{i}" for i in range(300)], random.Random(4)
    rows = [(i, " ".join(shared + [f"own{i}_{j}" for j in range(rng.choice((90, 150)))])) for i in range(40)]
    rows += [(100 + i, f"{t} more words") for i, t in rows[:5]]
    names, stage = [], gram_join.stage
    monkeypatch.setattr(gram_join, "stage", lambda df, name: names.append(name) or stage(df, name))
    got = gram_join.gram_join(docs(spark, rows), k=1, levels=(4,)).collect()
    assert sorted(((False, r.id), r.n, r.component) for r in got) == joined(rows, 1, 80)
    assert names.count("gj-counts") <= 3
