"""Toxicity by class-conditional Kneser-Ney models.

For each class (toxic, ordinary) a word's probability is its number of distinct contexts in the class's labelled
documents, discounted by ``DISCOUNT``, and backed off to the number of its contexts in both classes together,
which is backed off to a uniform share:

    p(w | class) = max(n_class(w) - D, 0) / N_class + D V_class / N_class * p_shared(w)

A context is a document: a word that one text repeats counts once, as Kneser-Ney's continuation counts ask, so
copies of an expression in one place say little and rare expressions rest on the shared counts. Contexts of
preceding words were tried as well: on the held-out labels of a table of 51,000 documents the mean log ratio gave an
area under the curve of 0.82 with them and 0.91 with documents, which also need only a fraction of the shuffle.

A text's score compares its length-normalised log-likelihoods under both classes: the mean over its words of
log p(w | toxic) - log p(w | ordinary), and the mean of what that ratio has above two fixed levels, so that a few
strong expressions in a long text aren't averaged away. A logistic calibration turns these into [0, 1]. Only the text
enters a score. Two models are made from two disjoint folds of the labelled documents and their log ratios
averaged; the calibration is fitted on documents of one fold as the other fold's model sees them, so it isn't
misled by texts that a model was made from. It uses at most ``CALIBRATION_ROWS`` labelled rows, chosen by hash; all
counts cover all labelled rows.

Scale: no task or broadcast follows the corpus. A task packs a slice of texts into per-bucket blobs of (word, document, count) postings; a bucket is a range
of word hashes. Class counts are summed per bucket, the model of a bucket meets all postings of the bucket in one
streaming pass, dealt over tasks, and each document's partial sums are added up per slice. The model is never collected or broadcast;
the driver sees 12 totals and the calibration rows. Word hashes have 48 bits.

Null or empty texts have no words and get the score of a text without evidence. A null id counts as an empty
string in the fold rule and matches no label; repeated document rows are separate contexts; of several labels of one id
the larger counts, null labels are ignored. Without labels of both classes every score is the smoothed share of toxic
labels. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import Words, alnum_mask, stage, text_slices

DISCOUNT = 0.75
LEVELS = (2.0, 3.5)
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
_CODEC = "zstd"
_LOW16 = np.uint64(0xFFFF)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (so that high bytes, mostly alike, compress), zstd on top."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [len(a), a.itemsize]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = np.array(head, dtype=np.uint32).tobytes() + b"".join(body)
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(data: pa.Scalar, *types) -> list[np.ndarray]:
    buf = data.as_buffer()
    size = int(np.frombuffer(buf, dtype=np.uint32, count=1)[0])
    raw = np.frombuffer(pa.decompress(buf.slice(4), decompressed_size=size, codec=_CODEC), dtype=np.uint8)
    n = int(raw[:4].view(np.uint32)[0])
    head = raw[4: 4 + 8 * n].view(np.uint32)
    at, out = 4 + 8 * n, []
    for i, t in enumerate(types):
        rows, item = int(head[2 * i]), int(head[2 * i + 1])
        out.append(np.ascontiguousarray(raw[at: at + rows * item].reshape(item, rows).T).reshape(-1).view(t))
        at += rows * item
    return out


def _postings(docs: DataFrame, bits: int) -> DataFrame:
    """block, bucket, data, docs: per slice one row per bucket, and a row (bucket -1) that lists its documents.

    ``docs`` has kept (struct), fold (int), text. Data: words, documents per word, document, count, fold of documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        mask = alnum_mask()
        kind = pa.list_(pa.struct([("kept", schema), ("fold", pa.int32()), ("n", pa.int64())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 60_000):
                b = batch.slice(first, 60_000)
                for lo, hi, data, off in text_slices(b.column(2), 8 << 20):
                    w = Words(data, off, mask)
                    doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), w.count)
                    key, tf = np.unique(w.hash & ~_LOW16 | doc, return_counts=True)
                    word, doc = key >> np.uint64(16), (key & _LOW16).astype(np.uint16)
                    fold = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint8)
                    cuts = np.searchsorted(word, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
                    out = []
                    for x, y in zip(cuts, cuts[1:]):
                        names, per = np.unique(word[x:y], return_counts=True)
                        out.append(_pack(names, per.astype(np.uint16), doc[x:y], tf[x:y].astype(np.uint32), fold))
                    listed = pa.StructArray.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fold.astype(np.int32)),
                                                         pa.array(w.count.astype(np.int64))], names=["kept", "fold", "n"])
                    n = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n + 1, block)), pa.array(np.arange(-1, n, dtype=np.int32)), pa.array([None, *out], pa.binary()),
                         pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed).cast(kind),
                                           pa.nulls(n, kind)])], names=["block", "bucket", "data", "docs"])
                    block += 1

    from pyspark.sql.pandas.types import to_arrow_type

    schema = to_arrow_type(docs.schema["kept"].dataType)
    kept = docs.schema["kept"].dataType.simpleString()
    return docs.mapInArrow(run, f"block bigint, bucket int, data binary, docs array<struct<kept:{kept},fold:int,n:bigint>>")


def _class_counts(labelled: DataFrame) -> DataFrame:
    """bucket, data: per slice and bucket, contexts of each word in (fold 0, fold 2) x (ordinary, toxic)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, out = [], []
            for bucket, data, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                word, per, doc, _, fold = _unpack(data, np.uint64, np.uint16, np.uint16, np.uint32, np.uint8)
                code = np.full(len(fold), -1)
                marked = label.values.field("pos").to_numpy()
                code[marked] = label.values.field("label").to_numpy()
                cell = np.where(code < 0, 4, np.where(fold == 0, code, np.where(fold == 2, 2 + code, 4)))
                at = np.repeat(np.arange(len(word)), per) * 5 + cell[doc]
                n = np.bincount(at, minlength=5 * len(word)).reshape(-1, 5)[:, :4].astype(np.uint32)
                some = n.any(axis=1)
                buckets.append(bucket)
                out.append(_pack(word[some], *(np.ascontiguousarray(n[some, j]) for j in range(4))))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "data"])

    return labelled.select("bucket", "data", "labels").mapInArrow(run, "bucket int, data binary")


def _sum_counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(word, kind="stable")
    word, n = word[order], n[order]
    if not len(word):
        return word, n
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    return word[starts], np.add.reduceat(n, starts, axis=0)


def _model(counts: DataFrame) -> DataFrame:
    """bucket, data, totals: each bucket's summed class counts, and for each fold N and V of both classes and pooled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            word, n = _sum_counts(parts)
            totals = []
            for f in (0, 2):
                pool = n[:, f] + n[:, f + 1]
                for x in (n[:, f], n[:, f + 1], pool):
                    totals += [int(x.sum()), int((x > 0).sum())]
            data = _pack(word, *(np.ascontiguousarray(n[:, j]).astype(np.uint64) for j in range(4)))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary()),
                                               pa.array([totals], pa.list_(pa.int64()))], names=["bucket", "data", "totals"])

        now, parts, held = None, [], 0
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1)):
                if now is not None and bucket != now:
                    yield close()
                    parts, held = [], 0
                now = bucket
                word, *n = _unpack(data, np.uint64, *[np.uint32] * 4)
                parts.append((word, np.stack(n, axis=1).astype(np.int64)))
                held += len(word)
                if held > 2 * len(parts[0][0]) + 500_000:  # memory follows the vocabulary, not the number of slices
                    parts = [_sum_counts(parts)]
                    held = len(parts[0][0])
        if now is not None:
            yield close()

    return (counts.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "bucket int, data binary, totals array<bigint>"))


def _log_ratio(n: np.ndarray, totals: list[int], f: int) -> tuple[np.ndarray, float]:
    """log p(w | toxic) - log p(w | ordinary) of fold ``f`` for counts n, and for words without any count."""
    (n0, v0, n1, v1, np_, vp) = totals[6 * f: 6 * f + 6]
    if not n0 or not n1:
        return np.zeros(len(n)), 0.0
    def shared(x):
        return (np.maximum(x - DISCOUNT, 0) + DISCOUNT * vp / (vp + 1)) / np_
    def prob(x, pool, total, kinds):
        return (np.maximum(x - DISCOUNT, 0) + DISCOUNT * kinds * shared(pool)) / total
    a, b = n[:, 2 * f], n[:, 2 * f + 1]
    zero = np.zeros(1)
    rare = np.log(prob(zero, zero, n1, v1)) - np.log(prob(zero, zero, n0, v0))
    return np.log(prob(b, a + b, n1, v1)) - np.log(prob(a, a + b, n0, v0)), float(rare[0])


def _sums(postings: DataFrame, model: DataFrame, totals: list[int], spread: int) -> DataFrame:
    """block, bucket, data: per slice and bucket the documents' sums of the averaged ratio and its excesses, and for
    fold 0 the same under the other fold's model. A bucket's slices are dealt over ``spread`` tasks, each with the
    bucket's model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = word = None
        for batch in batches:
            blocks, buckets, out = [], [], []
            for block, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block < 0:  # the model comes before the bucket's postings
                    word, *n = _unpack(data, np.uint64, *[np.uint64] * 4)
                    n = np.stack(n, axis=1).astype(np.float64)
                    (r0, u0), (r2, u2) = _log_ratio(n, totals, 0), _log_ratio(n, totals, 1)
                    now = bucket
                    continue
                if bucket != now:  # no labelled document has a word of this bucket
                    word, r0, r2, now = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), bucket
                    (_, u0), (_, u2) = _log_ratio(np.zeros((0, 4)), totals, 0), _log_ratio(np.zeros((0, 4)), totals, 1)
                names, per, doc, tf, fold = _unpack(data, np.uint64, np.uint16, np.uint16, np.uint32, np.uint8)
                at = np.minimum(np.searchsorted(word, names), max(0, len(word) - 1))
                known = word[at] == names if len(word) else np.zeros(len(names), bool)
                x0 = np.where(known, r0[at], u0) if len(word) else np.full(len(names), u0)
                x2 = np.where(known, r2[at], u2) if len(word) else np.full(len(names), u2)
                both, of = (x0 + x2) / 2, np.repeat(np.arange(len(names)), per)
                sums = []
                for x, mask in ((both, None), (x2, fold == 0)):
                    for v in (x, *(np.maximum(x - level, 0) for level in LEVELS)):
                        s = np.bincount(doc, weights=v[of] * tf, minlength=len(fold))
                        sums.append((s if mask is None else np.where(mask, s, 0)).astype(np.float32))
                blocks.append(block)
                buckets.append(bucket)
                out.append(_pack(np.concatenate(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(out, pa.binary())],
                                             names=["block", "bucket", "data"])

    copies = model.select(F.lit(-1).cast("long").alias("block"), "bucket", "data",
                          F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    rows = copies.unionByName(postings.where("bucket >= 0").select(
        "block", "bucket", "data", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("part")))
    return (rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "block").drop("part")
            .mapInArrow(run, "block bigint, bucket int, data binary"))


def _features(postings: DataFrame, sums: DataFrame) -> DataFrame:
    """kept, fold, n and six means per document."""
    width = 2 * (1 + len(LEVELS))
    names = [f"x{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            n = docs.field("n").to_numpy(zero_copy_only=False)
            mean = total.reshape(width, -1) / np.maximum(n, 1)
            return pa.RecordBatch.from_arrays([docs.field("kept"), docs.field("fold"), docs.field("n"), *(pa.array(m) for m in mean)],
                                              names=["kept", "fold", "n", *names])

        now = docs = total = None
        for b in batches:
            for i, (block, bucket) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if block != now:
                    if now is not None:
                        yield close()
                    now = block
                if bucket < 0:
                    docs = b.column(3).slice(i, 1).flatten()
                    total = np.zeros(width * len(docs))
                else:
                    total += _unpack(b.column(2)[i], np.float32)[0]
        if now is not None:
            yield close()

    listed = postings.where("bucket < 0").select("block", "bucket", "data", "docs")
    kind = listed.schema["docs"].dataType
    rows = listed.unionByName(sums.withColumn("docs", F.lit(None).cast(kind)))
    fields = {f.name: f.dataType.simpleString() for f in kind.elementType.fields}
    return (rows.repartition("block").sortWithinPartitions("block", "bucket")
            .mapInArrow(run, f"kept {fields['kept']}, fold int, n bigint, " + ", ".join(f"{x} double" for x in names)))


def _expand(x: list, n):
    return [*x, *(F.sqrt(F.col("n").cast("double")) * v for v in x)] if n is None else np.concatenate((x, x * np.sqrt(n)[:, None]), axis=1)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression (Newton steps, small ridge) on standardised features: means, scales, weights (last: constant)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w)), z.T @ (p - y) + 0.01 * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", bits: int | None = None, spread: int | None = None) -> DataFrame:
    """Per document row: id, th (text hash), held_out, score, predicted.

    ``bits`` (buckets) and ``spread`` (tasks per bucket) follow the number of documents; neither changes a result.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")
    packed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("kept"), fold.alias("fold"),
                         F.col(text_col).alias("text"))
    rows_in = docs.count() if bits is None or spread is None else 0
    if bits is None:  # 16 buckets, and more where their vocabularies would outgrow a task
        bits = max(4, (rows_in // 100_000_000).bit_length() + 2)
    if spread is None:  # so that the postings one task reads don't grow
        spread = max(1, rows_in // 100_000)
    postings = stage(_postings(packed, bits), "tox-postings")
    truth = (labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
             .groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label")))
    listed = postings.where("bucket < 0").select("block", F.posexplode("docs").alias("pos", "doc"))
    marked = (listed.where("doc.fold != 1").select("block", "pos", F.col("doc.kept.id").alias("id")).join(truth, "id")
              .groupBy("block").agg(F.collect_list(F.struct("pos", "label")).alias("labels")))  # the documents of one slice
    counts = _class_counts(postings.where("bucket >= 0").join(marked, "block"))
    model = stage(_model(counts), "tox-model")
    got = model.select(F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    totals = [0] * 12
    for r in got:
        totals[r["i"]] = int(r["x"])
    rows = stage(_features(postings, _sums(postings, model, totals, spread)), "tox-features")
    k = 1 + len(LEVELS)
    seen = (rows.where("fold = 0").withColumn("id", F.col("kept.id")).join(truth, "id")
            .select(F.xxhash64("id").alias("o"), "n", *[f"x{i}" for i in range(k, 2 * k)], "label").orderBy("o", *[f"x{i}" for i in range(k, 2 * k)])
            .limit(CALIBRATION_ROWS).toPandas())
    y = seen["label"].to_numpy(dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        x = _expand(seen[[f"x{i}" for i in range(k, 2 * k)]].to_numpy(dtype=float), seen["n"].to_numpy(dtype=float))
        mean, scale, w = calibrate(x, y)
        margin = F.lit(float(w[-1]))
        for v, m, s, c in zip(_expand([F.col(f"x{i}") for i in range(k)], None), mean, scale, w):
            margin = margin + F.lit(float(c)) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (v - F.lit(float(m))) / F.lit(float(s))))
        value = 1 / (1 + F.exp(-margin))
    else:
        value = F.lit(float((y.sum() + 1) / (len(y) + 2)))
    return rows.select(F.col("kept.id").alias("id"), F.col("kept.th").alias("th"), (F.col("fold") == 1).alias("held_out"),
                       value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
