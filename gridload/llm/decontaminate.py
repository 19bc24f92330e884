"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. In every run of ``window``
words the smallest hash of its ``k``-grams is the fingerprint, so any shared span of ``window`` words shares
one. Fingerprints of documents that may be the benchmark's (a prefilter of fixed size) are joined to the
benchmark's; a hit is extended to the whole window around it and counts only if all its words agree (64-bit
hash of the window). Items with fewer words are one window of their own length.

Texts aren't shuffled: a task turns a document into its word count and candidate windows. A passage that is in
many documents or items stays linear: windows with equal item sets form one class, documents with equal
classes one class set, and item lists are made once per class set.

Null texts have no words and no hits; items without words never occur; a null item id counts as an item and is
listed as an empty string; repeated document rows get equal results and repeated item ids are one item. An empty
benchmark or table gives no hits or no rows. Extra input columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import BoundedFilter, Words, alnum_mask, as_long, gram_starts, grams, lists, mix, stage, text_slices

WINDOW = "struct<start:int,size:int,fp:bigint,win:bigint>"


def _fingerprints(hashes: np.ndarray, size: int, k: int) -> np.ndarray:
    """Fingerprint of each run of ``size`` words: the least of its k-gram hashes."""
    g = grams(hashes, min(k, size))
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    low = g[:n]
    for j in range(1, size - min(k, size) + 1):
        low = np.minimum(low, g[j: j + n])
    return mix(low ^ np.uint64(size))


def _window_hash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(starts), size, dtype=np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ hashes[starts + j])
    return out


def _candidates(words: Words, sizes: list[int], k: int, keep) -> tuple[pa.Array, np.ndarray]:
    """Windows of the given sizes whose fingerprint passes ``keep``, as a flat struct array and counts per text."""
    parts = []
    for size in sizes:
        at = gram_starts(words.bounds, size)
        fp = _fingerprints(words.hash, size, k)[at] if len(at) else np.zeros(0, np.uint64)
        ok = keep(fp)
        at, fp = at[ok], fp[ok]
        parts.append((at, np.full(len(at), size, np.int32), fp, _window_hash(words.hash, at, size)))
    at, size, fp, win = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
    order = np.argsort(at, kind="stable")
    at, size, fp, win = at[order], size[order], fp[order], win[order]
    text = np.searchsorted(words.bounds, at, side="right") - 1
    flat = pa.StructArray.from_arrays(
        [pa.array((at - words.bounds[text]).astype(np.int32)), pa.array(size.astype(np.int32)),
         pa.array(as_long(fp.astype(np.uint64))), pa.array(as_long(win.astype(np.uint64)))],
        names=["start", "size", "fp", "win"])
    return flat, np.bincount(text, minlength=len(words.count))


def _item_windows(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """item, size, fp, win: each distinct window of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = alnum_mask()
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1)):
                w = Words(data, off, mask)
                for i in range(hi - lo):
                    h = w.hash[w.bounds[i]: w.bounds[i + 1]]
                    size = min(window, len(h))
                    if not size:
                        continue
                    n = len(h) - size + 1
                    fp = _fingerprints(h, size, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[lo + i].as_py()] * n, pa.string()), pa.array(np.full(n, size, np.int32)),
                         pa.array(as_long(fp)), pa.array(as_long(_window_hash(h, np.arange(n), size)))],
                        names=["item", "size", "fp", "win"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "item string, size int, fp bigint, win bigint").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 6,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: id, ``keep`` columns, n_words, spans (merged word spans that lie in a benchmark window),
    items (ids of the items with windows in it, sorted as strings)."""
    spark = docs.sparkSession
    bench = stage(_item_windows(items, item_id_col, item_text_col, window, k), "bench-windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `window` values
    may_hold = BoundedFilter(spark, bench.select("fp"), "fp").tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = alnum_mask()
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1)):
                w = Words(data, off, mask)
                flat, n = _candidates(w, sizes, k, may_hold)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)),
                                                  lists(flat, n)], names=["kept", "n_words", "found"])

    packed = docs.select(F.struct(id_col, *keep).alias("kept"), F.col(text_col).alias("text"))
    kept_type = packed.schema["kept"].dataType.simpleString()
    seen = stage(packed.mapInArrow(run, f"kept {kept_type}, n_words bigint, found array<{WINDOW}>")
                 .withColumn("rid", F.monotonically_increasing_id()), "doc-windows")

    classes = stage(bench.groupBy("size", "fp", "win").agg(
        F.struct(F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("b"),
                 F.count("*").alias("n")).alias("cls")), "bench-classes")
    class_items = bench.join(classes, ["size", "fp", "win"]).select("cls", "item").distinct()

    hits = stage(seen.select("rid", F.explode("found").alias("w")).select("rid", "w.*").join(classes, ["size", "fp", "win"])
                 .select("rid", "start", "size", "cls"), "doc-hits")
    # a document's own windows: no more than its words times the window sizes
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    span = lambda s: F.struct(s["start"].alias("lo"), (s["start"] + s["size"]).alias("hi"))

    def merge(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["start"] + s["size"]).alias("hi"))))
        return (F.when(F.size(acc) == 0, F.array(span(s))).when(s["start"] <= last["hi"], joined)
                .otherwise(F.concat(acc, F.array(span(s)))))

    by_doc = hits.groupBy("rid").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("start", "size"))), none, merge).alias("spans"))
    doc_classes = hits.select("rid", "cls").distinct()
    sets = doc_classes.groupBy("rid").agg(
        F.struct(F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("b"),
                 F.count("*").alias("n")).alias("cset"))
    of_set = (doc_classes.join(sets, "rid").select("cset", "cls").distinct().join(class_items, "cls")
              .select("cset", "item").distinct().groupBy("cset").agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = by_doc.join(sets, "rid").join(of_set, "cset").select("rid", "spans", "items")
    return (seen.select("rid", "kept", "n_words").join(found, "rid", "left")
            .select("kept.*", "n_words", F.coalesce("spans", none).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
