"""Every stage of the corpus pipeline and the whole of it, on a small table with planted and odd rows, against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridload.llm import toxicity
from gridload.llm.common import stage, table

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ITEMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = BLANKS.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def odd_dir(spark, small_dir, tmp_path_factory):
    """sf0.001 with copies, a benchmark passage, null and blank texts, repeated rows, null ids, and columns named as the stages' own."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    item = spark.read.parquet(f"{small_dir}/benchmark.parquet").where("text is not null").orderBy(F.length("text").desc()).first().text
    long = " ".join(f"w{i}" for i in range(400))
    plain = [(900001, long), (900002, long + " tail"), (900003, long), (900004, None), (900005, None), (900006, ""), (900007, " \t"),
             (900008, "before it " + item + " and after it"), (None, "a text without id of its own"), (None, None), (None, None),
             (900009, "said twice in one row each"), (900009, "said twice in one row each"), (900010, "x" * 300_000)]
    extra = spark.createDataFrame([(i, t, "odd") for i, t in plain], "doc_id long, text string, source string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    both.withColumn("shard", F.lit("mine")).withColumn("th", F.lit(1)).withColumn("k", F.lit(2)).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())


def test_toxicity_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    out = P.drop_toxic(spark, docs, odd_dir)
    assert out.columns == docs.columns
    bad = {r.id for r in toxicity.score(docs, table(spark, odd_dir, "labels")).where("predicted = 1").select("id").collect()}
    texts = {t for i, t, _ in rows_of(docs) if i in bad}
    assert rows_of(out) == Counter({k: n for k, n in rows_of(docs).items() if k[1] not in texts})


def test_near_duplicate_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    out = P.drop_near_duplicates(spark, docs, odd_dir)
    assert out.columns == docs.columns
    got, given = rows_of(out), rows_of(docs)
    assert all(n <= given[k] for k, n in got.items())
    texts = [t for t in {k[1] for k in given} if BLANKS.search(t or "")]
    sets, holding = [shingles(t) for t in texts], defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holding[g].add(i)
    group = list(range(len(texts)))

    def head(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holding[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                group[head(i)] = head(j)
    kept = Counter(head(texts.index(t)) for (_, t, _), n in got.items() for _ in range(n) if BLANKS.search(t or ""))
    assert set(kept) == {head(i) for i in range(len(texts))} and set(kept.values()) == {1}
    assert {k: n for k, n in got.items() if not BLANKS.search(k[1] or "")} == {k: n for k, n in given.items() if not BLANKS.search(k[1] or "")}


def test_decontamination_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    out = P.drop_contaminated(spark, docs, odd_dir)
    assert out.columns == docs.columns
    windows = defaultdict(set)
    for r in table(spark, odd_dir, "benchmark").collect():
        w = ITEMS.findall(lower(r.text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[min(10, len(w))].add(tuple(w[i:i + 10]))

    def hit(text):
        w = ITEMS.findall(lower(text))
        return any(tuple(w[i:i + n]) in held for n, held in windows.items() for i in range(len(w) - n + 1))

    want = Counter({k: n for k, n in rows_of(docs).items() if not hit(k[1])})
    assert rows_of(out) == want and 900008 not in {k[0] for k in want}


def test_mixing_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    out = P.mix_sources(spark, docs, odd_dir)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for (_, t, s), n in rows_of(docs).items():
        words[s] += n * len(BLANKS.findall(t or ""))
    mixed = defaultdict(int)
    for (_, t, s), n in rows_of(out).items():
        mixed[s] += n * len(BLANKS.findall(t))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(words.values()), set()
    while True:
        share = (total - sum(3 * words[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        new = {s for s in order if s not in full and share * weight[s] > 3 * words[s]}
        if not new:
            break
        full |= new
    for s in order:
        assert abs(mixed[s] - (3 * words[s] if s in full else share * weight[s])) <= 1


def test_sharding_stage(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    out = P.deal_shards(spark, docs, odd_dir)
    assert Counter(out.columns) == Counter({*docs.columns, "shard", "shard_bytes"})
    assert rows_of(out) == rows_of(docs)
    held = defaultdict(lambda: [0, 0, set()])
    for r in out.select("text", "shard", "shard_bytes").collect():
        h = held[r.shard]
        h[0], h[1] = h[0] + len((r.text or "").encode()), h[1] + 1
        h[2].add(r.shard_bytes)
    assert all(b <= P.SHARD_BYTES or n == 1 for b, n, _ in held.values())
    assert all(said == {b} for b, _, said in held.values()) and "mine" not in held


def test_run_is_its_stages_and_survives_an_empty_table(spark, odd_dir, tmp_path):
    out = stage(P.run(spark, odd_dir), "pipeline-run")
    docs = table(spark, odd_dir, "documents")
    kept = docs
    for _, fn in P.STAGES[:3]:
        kept = stage(fn(spark, kept, odd_dir), "pipeline-kept")
    left = {k[0] for k in rows_of(kept)}
    assert out.count() > 0 and {k[0] for k in rows_of(out)} <= left
    assert 900008 not in left and len({900001, 900002, 900003} & left) == 1
    root = str(tmp_path)
    docs.limit(0).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, odd_dir, name).write.parquet(f"{root}/{name}.parquet")
    assert P.run(spark, root).count() == 0
