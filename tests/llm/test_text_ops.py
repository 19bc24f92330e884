"""Near duplicates, components, decontamination, toxicity and the tokeniser against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridload.llm import common, decontaminate, minhash, toxicity
from gridload.llm.components import components

SCHEMA = "doc_id long, text string, node string, keys string, bucket long, comp long, n long, kept string, rid long, spans int, items int, fold int, block int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_tokeniser_matches_the_pattern():
    rng = random.Random(3)
    texts = [None, "", " ", "É b\x00c", "A" * 9000 + " b", *["".join(rng.choices("aB \t\n éß1-.", k=rng.randint(0, 40))) for _ in range(300)]]
    for mask, pattern in ((common.blank_mask(), r"[^\x20\x09-\x0D]+"), (common.alnum_mask(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, seen = [], {}
        for lo, hi, data, off in common.text_slices(pa.array(texts), 64):
            w = common.Words(data, off, mask)
            got += [w.hash[w.bounds[i]: w.bounds[i + 1]].tolist() for i in range(hi - lo)]
        for t, hashes in zip(texts, got):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            assert len(want) == len(hashes)
            for word, h in zip(want, hashes):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_sketches_fill_every_bin_and_estimate_similarity():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [flat[:1], flat[:7], flat[:600], flat[100:700], flat[600:900]]
    s = minhash.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 400)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[2] == s[3]).mean() - 5 / 7) < 0.1 and (s[2] == s[4]).mean() < 0.05


def brute_components(rows, k):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    low = {r: min(g, key=lambda x: (x is None, x)) for r, g in groups.items()}
    return [(rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))]


def near_rows(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))] for _ in range(12)]
    rows = []
    for i in range(130):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i * 3 + 1, " ".join(t)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  b"), (505, "a b c"), (None, rows[0][1]), (1, rows[0][1])]
    rows.append((600, " ".join(f"u{j}" for j in range(30_000))))
    return rows


@pytest.mark.parametrize("seed,small,chunk", [(1, 24, 256), (2, 1, 4)])
def test_near_duplicates(spark, monkeypatch, seed, small, chunk):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = near_rows(seed)
    got = minhash.near_duplicates(docs_of(spark, rows), k=4).select("id", "n", "component").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, 4), key=key)


def test_one_of_each_group_stays(spark):
    rows = near_rows(5)
    docs = docs_of(spark, rows)
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    want = {c for _, n, c in brute_components(rows, 5) if n} | {500, 501, 502}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_rows_without_words_all_stay(spark):
    rows = [(None, None), (None, None), (None, ""), (7, " \n"), (7, " \n"), (8, "a b c"), (8, "a b c")]
    out = minhash.one_of_each(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, ""), (0, ""), (0, ""), (7, " \n"), (7, " \n"), (8, "a b c")]


def test_no_documents(spark):
    none = docs_of(spark, [])
    assert minhash.near_duplicates(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(none, items).count() == 0
    assert [r.n_words for r in decontaminate.find_contamination(docs_of(spark, [(1, "a b")]), items).collect()] == [2]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, labels).count() == 0
    assert [r.score for r in toxicity.score(docs_of(spark, [(1, "a b")]), labels).collect()] == [0.5]


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299)] + [(order[i], order[i + 1]) for i in range(310, 390)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    first, second = set(order[:300]), set(order[310:391])
    assert {n for n in got if n in first} == first and {got[n] for n in first} == {min(first)}
    assert {got[n] for n in second} == {min(second)}


def test_contamination(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(30)] + ["été", "Ü9"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(12)] + [(12, "Alone"), (13, None), (14, ""), (None, "un deux, trois"), (3, "v1 v2 v3 v4")]
    shared = items[5][1] + " tail"
    items.append((20, shared))
    rows = []
    for i in range(60):
        t = rng.choices(vocab, k=rng.randint(0, 60))
        if i % 3 == 0:
            src = re.sub(r"\W+", "-", rng.choice(items)[1] or "")
            t[3:3] = [src.upper() if i % 2 else src]
        rows.append((i, " ".join(t)))
    rows += [(70, None), (71, ""), (None, items[2][1]), (72, "x " * 3000 + (items[5][1])), (72, "x " * 3000 + (items[5][1])), (73, "ALONE!")]

    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = toks(t)
        z = min(10, len(w))
        for j in range(len(w) - z + 1 if z else 0):
            windows[tuple(w[j: j + z])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    want = []
    for i, t in rows:
        w, hit, found = toks(t), set(), set()
        for z in sizes:
            for j in range(len(w) - z + 1):
                if (x := windows.get(tuple(w[j: j + z]))) is not None:
                    hit |= set(range(j, j + z))
                    found |= x
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    got = [(r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), tuple(r.items)) for r in decontaminate.find_contamination(
        docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(1 for r in want if r[2]) > 10


def labelled(spark, n=900, seed=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = rng.choices(vocab, k=rng.randint(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(t) // 30)):
                t.insert(rng.randrange(len(t)), rng.choice(["vile", "scummy", "rotten"]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "w1 w2 vile"), (5002, docs[6][1]), (5002, docs[6][1]), (5003, "w3 " * 40_000)]
    labels += [(5001, None), (None, 1), (3, 0), (3, 0)]
    return docs, docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    plain, docs, labels = labelled(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(plain)
    import zlib
    held = [r for r in got if r.held_out and r.id is not None and r.id < 5000]
    assert {r.id for r in held} == {i for i, _ in plain if i is not None and i < 5000 and zlib.crc32(str(i).encode()) % 3 == 1}
    caught = [r.predicted for r in held if r.id % 6 == 0]
    wrong = [r.predicted for r in held if r.id % 6]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.02 * len(wrong)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.id].add(round(r.score, 9))
    assert by[5002] == by[6] and by[5000] == by[5001]  # only the text counts
    other = toxicity.score(docs, labels, bits=2, spread=3).collect()
    assert sorted((r.th, round(r.score, 6)) for r in other) == sorted((r.th, round(r.score, 6)) for r in got)


def test_toxicity_counts_by_brute_force(spark):
    """The model's totals: distinct (document, word) contexts per class and fold."""
    import zlib
    plain, docs, labels = labelled(spark, 200)
    lab = {r.doc_id: max(r.toxic or 0, 0) for r in labels.where("toxic is not null and doc_id is not null").collect()}
    n = defaultdict(int)
    for i, t in plain:
        f = zlib.crc32(("" if i is None else str(i)).encode()) % 3
        if i in lab and f != 1:
            for w in set(re.findall(r"[a-z0-9]+", (t or "").lower())):
                n[(f, lab[i])] += 1
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")
    posts = toxicity._postings(docs.select(F.struct(F.col("doc_id").alias("id"), F.lit(1).alias("th")).alias("kept"), fold.alias("fold"), "text"), 2).cache()
    truth = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    marks = (posts.where("bucket < 0").select("block", F.posexplode("docs").alias("pos", "doc")).withColumn("doc_id", F.col("doc.kept.id")).join(truth, "doc_id")
             .where("doc.fold != 1").groupBy("block").agg(F.collect_list(F.struct("pos", "label")).alias("labels")))
    model = toxicity._model(toxicity._class_counts(posts.where("bucket >= 0").join(marks, "block")))
    totals = np.sum([r.totals for r in model.collect()], axis=0)
    assert [int(totals[j]) for j in (0, 2, 6, 8)] == [n[(0, 0)], n[(0, 1)], n[(2, 0)], n[(2, 1)]]
