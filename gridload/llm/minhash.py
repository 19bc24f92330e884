"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

A document's set holds the 64-bit hashes of its distinct shingles (``k`` words; the whole sequence as one if it
has fewer). A sketch has ``bands * rows`` coordinates, filled in rounds: in round r < t every element goes to
one hashed bin with value (r, hash); in round t+j all elements go to bin j. A coordinate keeps its least value,
and a document stops after the round in which every bin is filled, which bounds the rounds at 2t and leaves no
bin empty. Documents that agree on all rows of a band are candidates; every link is confirmed on the full sets.

Equal sets are one node (128-bit set hash), so copies are never paired. In a band bucket, members are first
compared with one leader (the member with most bucket mates), which joins most of a group with one comparison
each. Whoever is still in another component than the largest of a bucket is then compared with all members
of other components there, so no candidate link is left out; sizes that rule the threshold out are skipped. In
small buckets these comparisons are joined pairs; in large ones, blocks of ``CHUNK`` members meet in a task, which
compares what no earlier band has brought together and returns only links, so no group is paired out.
Missed only are links that share no band: at the threshold itself, (1 - 0.8^rows)^bands = 2e-6.

Null or empty texts have empty sets, linked with nothing. Repeated rows are separate documents of one set.
Ties go to the smallest id; null ids sort last. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import WORD, BoundedFilter, Words, as_long, blank_mask, gram_starts, grams, mix, stage, text_slices
from gridload.llm.components import components

BANDS, ROWS = 25, 4
#: Members of a block in buckets of over SMALL members; both only divide the work, all comparisons are made.
CHUNK, SMALL = 256, 24


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their bounds."""
    at = gram_starts(words.bounds, k)
    g = grams(words.hash, k)[at]
    cut = np.searchsorted(at, words.bounds)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        g[lo:hi].sort()
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    new[cut[cut < len(g)]] = True
    flat, bounds = g[new], np.concatenate(([0], np.cumsum(new)))[cut]
    few = (words.count > 0) & (words.count < k)
    if few.any():
        whole = [grams(words.hash[words.bounds[i]: words.bounds[i + 1]], int(words.count[i])) for i in np.flatnonzero(few)]
        flat = np.insert(flat, bounds[:-1][few], np.concatenate(whole))
        bounds = bounds + np.concatenate(([0], np.cumsum(few)))
    return flat, bounds


def sketches(flat: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of each non-empty set (rows of empty sets stay at the maximum)."""
    n = len(bounds) - 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), top, dtype=np.uint64)
    cells = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    low32 = np.uint64(0xFFFFFFFF)
    for r in range(2 * t):
        if not len(flat):
            break
        h = mix(flat + np.uint64((r + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        if r < t:
            where = owner * t + (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            where = owner * t + (r - t)
        np.minimum.at(cells, where, (np.uint64(r) << np.uint64(32)) | (h & low32))
        open_ = (out == top).any(axis=1)
        live = open_[owner]
        flat, owner = flat[live], owner[live]
    return out


def set_ids(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit id of each set (as rows of 16 bytes): two independent sums of mixed hashes."""
    ids = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            ids[full, j] = np.add.reduceat(mix(flat ^ np.uint64(salt)), bounds[full])
    return ids


def _binary16(ids: np.ndarray, empty: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(ids).tobytes())
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, data])
    return pc.if_else(pa.array(empty), pa.scalar(None, pa.binary()), fixed.cast(pa.binary()))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """kept (struct of the id and a text hash), n (set size), node (set id, null if empty), keys (band keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, salt = blank_mask(), np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1), 1 << 20):
                flat, bounds = shingle_sets(Words(data, off, mask), k)
                n = np.diff(bounds)
                s = sketches(flat, bounds, bands * rows).reshape(len(n), bands, rows)
                key = np.broadcast_to(salt, (len(n), bands))
                for j in range(rows):
                    key = mix(key ^ s[:, :, j])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)),
                                                pa.array(as_long(np.ascontiguousarray(key).reshape(-1))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n),
                                                  _binary16(set_ids(flat, bounds), n == 0), keys],
                                                 names=["kept", "n", "node", "keys"])

    packed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("kept"),
                         F.col(text_col).alias("text"))
    kept = packed.schema["kept"].dataType.simpleString()
    return packed.mapInArrow(run, f"kept {kept}, n bigint, node binary, keys array<bigint>")


def _sets_of(docs: DataFrame, text_col: str, k: int, wanted: BoundedFilter) -> DataFrame:
    """node, items (sorted shingle hashes as bytes) of the sets that ``wanted`` may hold."""
    may_hold = wanted.tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = blank_mask()
        for b in batches:
            for _, _, data, off in text_slices(b.column(0)):
                flat, bounds = shingle_sets(Words(data, off, mask), k)
                ids = set_ids(flat, bounds)
                rows = np.flatnonzero((np.diff(bounds) > 0) & may_hold(ids[:, 0]))
                if len(rows):
                    rows = rows[np.unique(ids[rows], axis=0, return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays(
                        [_binary16(ids[rows], np.zeros(len(rows), bool)),
                         pa.array([flat[bounds[i]: bounds[i + 1]].tobytes() for i in rows], pa.binary())],
                        names=["node", "items"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node binary, items binary")
            .groupBy("node").agg(F.first("items").alias("items")))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(run, "a binary, b binary"))


def _confirm_blocks(open_: DataFrame, keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in large buckets, one per member and component met.

    Members outside the largest component (asking) are dealt into blocks, all members into blocks, and each pair of
    blocks is one group. A pair is compared in the first band that both share.
    """
    def blocks(count):
        return F.ceil(F.col(count) / CHUNK).cast("int")

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        node, comp = t.column("node").to_pylist(), np.array(t.column("comp").to_pylist(), dtype=object)
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        key = np.array(t.column("keys").to_pylist(), dtype=np.int64).reshape(len(node), -1)
        band = int(np.flatnonzero((key == t.column("bucket")[0].as_py()).all(axis=0))[0])
        items = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in t.column("items").combine_chunks()]
        size = np.array([len(v) for v in items])
        other, order = np.flatnonzero(~asks), np.array(node, dtype=object)
        big = t.column("big")[0].as_py()
        a, b = [], []
        if len(other):
            for i in np.flatnonzero(asks):
                ok = ((comp[other] != comp[i]) & ((comp[other] == big) | (order[other] > node[i]))
                      & (np.minimum(size[other], size[i]) * 100 >= np.maximum(size[other], size[i]) * percent)
                      & ~(key[other, :band] == key[i, :band]).any(axis=1))
                js = other[ok]
                if not len(js):
                    continue
                flat = np.concatenate([items[j] for j in js])
                at = np.minimum(np.searchsorted(items[i], flat), size[i] - 1)
                common = np.add.reduceat((items[i][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(size[js])[:-1])))
                met = js[100 * common >= percent * (size[js] + size[i] - common)]
                for j in {comp[j]: j for j in met}.values():
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    asking = (open_.where(F.col("comp") != F.col("big")).withColumn("asks", F.lit(True))
              .withColumn("p", F.pmod(F.xxhash64("node"), blocks("u")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), blocks("m") - 1))))
    asked = (open_.withColumn("asks", F.lit(False)).withColumn("q", F.pmod(F.xxhash64("node", F.lit(1)), blocks("m")).cast("int"))
             .withColumn("p", F.explode(F.sequence(F.lit(0), blocks("u") - 1))))
    dealt = asking.select("bucket", "p", "q", "node", "comp", "big", "asks").unionByName(
        asked.select("bucket", "p", "q", "node", "comp", "big", "asks"))
    return dealt.join(keys, "node").join(sets, "node").groupBy("bucket", "p", "q").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document row: id, th (text hash), n (set size), component (smallest id of its near-duplicate group), grp (one
    value per group, null for empty sets)."""
    spark = docs.sparkSession
    sig = stage(signatures(docs, id_col, text_col, k, bands, rows), "nd-signatures")
    first_id = F.min(F.struct(F.col("kept.id").isNull().alias("none"), F.col("kept.id").alias("id"))).alias("low")
    nodes = stage(sig.where(F.col("node").isNotNull()).groupBy("node").agg(
        first_id, F.first("n").alias("n"), F.first("keys").alias("keys")), "nd-nodes")
    members = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    # a pair can only reach the threshold if the smaller set has at least that share of the larger
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    buckets = stage(members.join(shared, "bucket"), "nd-buckets")
    degree = buckets.groupBy("node").agg(F.sum("m").alias("degree"))
    ranked = stage(buckets.join(degree, "node").select("bucket", "node", "n", "degree"), "nd-ranked")
    wanted = BoundedFilter(spark, ranked.select("node").distinct().select(_head("node").alias("h")), "h")
    sets = stage(_sets_of(docs, text_col, k, wanted), "nd-sets")

    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "n", "node")).alias("lead"))
    star = stage(ranked.join(leaders, "bucket").where((F.col("node") != F.col("lead.node")) & fits(F.col("n"), F.col("lead.n")))
                 .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "nd-star")
    links = stage(_confirm(star, sets, percent), "nd-links")
    label = components(links)

    placed = stage(ranked.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"), "nd-placed")
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    largest = (sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("big"))
               .where(F.col("comps") > 1).select("bucket", "m", (F.col("m") - F.col("big.c")).alias("u"), F.col("big.comp").alias("big")))
    open_ = stage(placed.join(largest, "bucket").drop("degree"), "nd-open")
    few = open_.where(F.col("m") <= SMALL)
    x = few.where(F.col("comp") != F.col("big")).select("bucket", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "comp")])
    y = few.select("bucket", "big", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "comp")])
    rest = (x.join(y, "bucket").where((F.col("comp1") != F.col("comp2")) & fits(F.col("n1"), F.col("n2"))
                                      & ((F.col("comp2") == F.col("big")) | (F.col("node1") < F.col("node2"))))
            .select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
            .join(star, ["a", "b"], "left_anti"))
    more = stage(_confirm(stage(rest, "nd-rest"), sets, percent).unionByName(
        _confirm_blocks(open_.where(F.col("m") > SMALL), nodes.select("node", "keys"), sets, percent)), "nd-more")
    final = components(links.unionByName(more))

    low = nodes.select("node", "low").join(final, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    lowest = low.groupBy("comp").agg(F.min("low").alias("component"))
    by_node = low.join(lowest, "comp").select("node", F.col("component.id").alias("component"), F.col("comp").alias("grp"))
    full, empty = sig.where(F.col("node").isNotNull()), sig.where(F.col("node").isNull())
    return (full.join(by_node, "node").select("kept.id", "kept.th", "n", "component", "grp")
            .unionByName(empty.select("kept.id", "kept.th", "n", F.col("kept.id").alias("component"),
                                      F.lit(None).cast("binary").alias("grp"))))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each near-duplicate group: that with the smallest id (null last).

    Rows without words all stay, repeated ones too. Of repeated rows with words (equal id and text) one stays.
    """
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    found = near_duplicates(docs, id_col, text_col, **options)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    kept = found.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.min(rank).alias("f")).select("f.id", "f.th")
    kept = stage(kept.select(F.xxhash64("id", "th").alias("k")).distinct(), "nd-kept")
    rows = docs.where(worded).select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("k"))
    return rows.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*").unionByName(docs.where(~worded))


def _head(col: str):
    """The first 8 bytes of a set id, which are little-endian, as a long."""
    return F.expr("cast(conv(concat(" + ", ".join(f"substr(hex({col}), {2 * i + 1}, 2)" for i in range(7, -1, -1))
                  + "), 16, -10) as bigint)")
