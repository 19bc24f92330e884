"""Hard-negative mining by inner products over an STR-packed R-tree.

Vectors become integers floor(scale * c). The tree: rows are range partitioned by one coordinate into slabs of about
``SLAB`` rows, each slab is tiled by further coordinates, sort-tile-recursive, into leaves of ``LEAF`` rows; ties go by
id, so equal vectors fill leaves in id order. The packed rows are a staged table. A task takes it slab by slab, and a
slab is a tree: a minimum bounding box per leaf and per group of leaves. A box gives an interval per coordinate and
so an interval of inner products with an anchor. A queue opens the box with the largest upper end first; a
box is passed over when its interval lies outside every score window still asked for, or its upper end is strictly
below the kth score found (or equal to it, with only larger ids inside).

Anchors are broadcast in blocks of at most ``BLOCK_BYTES`` and meet every slab: a stated query set against all rows.
First each anchor is searched in its own slab alone, then in growing shares of the slabs, at last in all; the
kth scores of one pass prune the next, so few rows leave a task however many slabs there are. Two such searches:
an anchor's positives (best rows of its label), then, per positive, the best rows of other labels in its window.

Rows with a null id, label or vector, with null or non-finite components, or of another length than most take no part.
Integers too large for a product to fit a long become the largest that fits. Labels are compared as longs, other
types by a 64-bit hash. A row is never its own partner, nor is any row with the anchor's id; repeated rows are partners each,
a repeated anchor id asks once (its smallest label and vector). Ties go to smaller ids, then to any of the equal rows. An anchor
without positives or a positive without rows in its window gives no row; so does an empty table. Extra columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import stage
from gridload.llm.vectors import doubles, finite, matrix, scaled_floor, usual_width

LEAF, FANOUT, SLAB = 256, 16, 16384
BLOCK_BYTES = 16 << 20
#: Each pass over slabs covers so many times the share of the one before.
GROWTH = 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _longs(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tiles(x: np.ndarray, ids: np.ndarray, dims: list[int], leaf: int) -> np.ndarray:
    """Row order of a sort-tile-recursive packing into runs of ``leaf`` rows."""
    order = np.arange(len(x))

    def pack(rows: np.ndarray, k: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        rows = rows[np.lexsort((ids[rows], x[rows, dims[k]]))]
        if pages <= 1 or k + 1 == len(dims):
            return [rows]
        slabs = math.ceil(pages ** (1 / (len(dims) - k)))
        size = -(-pages // slabs) * leaf
        return [part for lo in range(0, len(rows), size) for part in pack(rows[lo: lo + size], k + 1)]

    return np.concatenate(pack(order, 0))


def build_tree(rows: DataFrame, width: int, total: int) -> DataFrame:
    """slab, id, label, asks, vec (longs) in packed order; ``rows``: id, label, asks, vec (doubles of integers)."""
    spread = rows.select(F.posexplode("vec").alias("d", "v")).groupBy("d").agg(F.stddev_pop("v").alias("s")).orderBy(F.desc("s"), "d")
    dims = [r.d for r in spread.limit(4).collect()]
    first, rest = dims[0], dims[1:] or dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, cut = 0, 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            ids, x = t.column("id").to_numpy(), _longs(t.column("vec").combine_chunks(), width)
            slab = int(ids[0]) ^ (cut << 48)
            t = t.take(pa.array(_tiles(x, ids, rest, LEAF))).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), slab)), *[t.column(c).combine_chunks() for c in t.column_names]],
                                              names=["slab", *t.column_names])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(SLAB - held, b.num_rows - at)
                waiting.append(b.slice(at, take))
                at, held = at + take, held + take
                if held == SLAB:
                    yield packed()
                    waiting, held, cut = [], 0, cut + 1
        if held:
            yield packed()

    coordinate = F.get("vec", F.lit(first))
    dealt = (rows.withColumn("c", coordinate).repartitionByRange(max(1, -(-total // SLAB)), "c", "id").sortWithinPartitions("c", "id")
             .select("id", "label", "asks", F.transform("vec", lambda v: v.cast("long")).alias("vec")))
    return stage(dealt.mapInArrow(run, "slab bigint, id bigint, label bigint, asks boolean, vec array<bigint>"), "hn-tree")


class _Tree:
    """Boxes over the packed rows of one slab: leaves of ``LEAF`` rows, then groups of ``FANOUT`` up to one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        cuts = np.arange(0, len(ids), LEAF)
        lo, hi, low_id = (np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts), np.minimum.reduceat(ids, cuts))
        self.leaves = len(cuts)
        los, his, low_ids, self.children = [lo], [hi], [low_id], {}
        base, n = 0, len(cuts)
        while n > 1:
            cuts = np.arange(0, n, FANOUT)
            for i, c in enumerate(cuts):
                self.children[base + n + i] = range(base + c, base + min(c + FANOUT, n))
            los.append(np.minimum.reduceat(los[-1], cuts))
            his.append(np.maximum.reduceat(his[-1], cuts))
            low_ids.append(np.minimum.reduceat(low_ids[-1], cuts))
            base, n = base + n, len(cuts)
        self.root = base
        self.lo, self.hi, self.low_id = np.concatenate(los), np.concatenate(his), np.concatenate(low_ids)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T


class _Best:
    """The best ``k`` (score, id) within one score window; starts from a bound that k known rows reach."""

    def __init__(self, key: int, low: int, high: int, bound: int, bound_id: int, k: int):
        self.key, self.high, self.k = key, high, k
        self.floor, self.floor_id = (bound, bound_id) if bound >= low else (low, _MOST)  # equal scores count up to this id
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def wants(self, least: int, most: int, low_id: int) -> bool:
        return least <= self.high and (most > self.floor or (most == self.floor and low_id <= self.floor_id))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score <= self.high) & ((score > self.floor) | ((score == self.floor) & (ids <= self.floor_id)))
        if not ok.any():
            return
        score, ids = np.concatenate((self.score, score[ok])), np.concatenate((self.id, ids[ok]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.floor, self.floor_id = int(self.score[-1]), int(self.id[-1])


def _best_first(tree: _Tree, anchor: np.ndarray, own: int, label: int, same: bool, windows: list[_Best],
                least: np.ndarray, most: np.ndarray) -> None:
    """Open boxes by falling upper end while some window wants them; ``least``/``most``: the boxes' intervals."""
    queue = [(-most[tree.root], tree.root)]
    while queue:
        top, box = heapq.heappop(queue)
        if -top < min(w.floor for w in windows):
            return
        if not any(w.wants(least[box], -top, tree.low_id[box]) for w in windows):
            continue
        if box >= tree.leaves:
            floor = min(w.floor for w in windows)
            for c in tree.children[box]:
                if most[c] >= floor:
                    heapq.heappush(queue, (-most[c], c))
            continue
        rows = slice(box * LEAF, (box + 1) * LEAF)
        score = (tree.x[rows] @ anchor).astype(np.int64)
        ok = ((tree.labels[rows] == label) == same) & (tree.ids[rows] != own) & (score >= min(w.floor for w in windows))
        if ok.any():
            score, ids = score[ok], tree.ids[rows][ok]
            for w in windows:
                w.add(score, ids)


def _search_block(tree: DataFrame, asks: DataFrame, width: int, kind, k: int, same: bool, own_slab: bool) -> DataFrame:
    """anchor, key, score, id: the best rows each task finds for the block's windows, better than their bounds."""
    rows = asks.toArrow()  # at most BLOCK_BYTES
    wins = [rows.column("windows").combine_chunks()]
    col = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("anchor", "label")}
    order = np.argsort(col["anchor"], kind="stable")
    packed = (col["anchor"][order], col["label"][order], _longs(rows.column("vec").combine_chunks(), width)[order].astype(kind),
              [wins[0][int(i)].as_py() for i in order])
    shared = asks.sparkSession.sparkContext.broadcast(packed)

    def search(tree: _Tree) -> Iterator[pa.RecordBatch]:
        anchor, label, vec, windows = shared.value
        at = np.flatnonzero(np.isin(anchor, tree.ids)) if own_slab else np.arange(len(anchor))
        found = []
        for lo in range(0, len(at), 1024):
            part = at[lo: lo + 1024]
            least, most = tree.intervals(vec[part])
            for i, a in enumerate(part):
                best = [_Best(w["key"], w["low"], w["high"], w["bound"], w["bound_id"], k) for w in windows[a]]
                _best_first(tree, vec[a], anchor[a], label[a], same, best, least[i], most[i])
                found += [(anchor[a], w.key, w.score, w.id) for w in best if len(w.id)]
        if found:
            count = [len(f[3]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([f[0] for f in found], np.int64), count)), pa.array(np.repeat(np.array([f[1] for f in found], np.int64), count)),
                 pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found]))],
                names=["anchor", "key", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        slab = None

        def built() -> _Tree:
            t = pa.Table.from_batches(waiting)
            return _Tree(t.column("id").to_numpy(), t.column("label").to_numpy(),
                         _longs(t.column("vec").combine_chunks(), width).astype(kind))

        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                if waiting and keys[lo] != slab:
                    yield from search(built())
                    waiting = []
                slab = keys[lo]
                waiting.append(b.slice(lo, hi - lo))
        if waiting:
            yield from search(built())

    return tree.select("slab", "id", "label", "vec").mapInArrow(run, "anchor bigint, key bigint, score bigint, id bigint")


def _dealt(asks: DataFrame, row_bytes: int) -> list[DataFrame]:
    """The asks by hash in blocks of at most ``BLOCK_BYTES``; sizes are checked before anything is broadcast."""
    most, parts = max(1, BLOCK_BYTES // row_bytes), max(1, -(-5 * asks.count() * row_bytes // (4 * BLOCK_BYTES)))
    while True:
        dealt = asks.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
        if (dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        parts *= 2
    dealt = stage(dealt, "hn-asks")
    return [dealt.where(F.col("block") == b).drop("block") for b in range(parts)]


def _search(tree: DataFrame, anchors: DataFrame, windows: DataFrame, width: int, kind, k: int, same: bool, slabs: int) -> DataFrame:
    """anchor, key, score, id, rank: the best ``k`` rows of each window. ``windows``: anchor, key, low, high."""
    shares = [F.lit(True)]
    for i in range(1, 64):
        if slabs < GROWTH ** i:
            break
        shares.insert(0, F.pmod(F.xxhash64("slab"), F.lit(GROWTH ** i)) == 0)
    best = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
    found = None
    for own_slab, part in [(True, shares[-1]), *[(False, s) for s in shares]]:
        bound = F.lit(_LEAST).alias("bound"), F.lit(_MOST).alias("bound_id")
        open_ = windows.select("*", *bound)
        if found is not None:
            kth = found.where(F.col("rank") == k).select("anchor", "key", F.col("score").alias("bound"), F.col("id").alias("bound_id"))
            open_ = windows.join(kth, ["anchor", "key"], "left").select(
                *windows.columns, F.coalesce("bound", F.lit(_LEAST)).alias("bound"), F.coalesce("bound_id", F.lit(_MOST)).alias("bound_id"))
        # at most as many windows as an anchor has positives
        asks = open_.groupBy("anchor").agg(F.collect_list(F.struct("key", "low", "high", "bound", "bound_id")).alias("windows")).join(anchors, "anchor")
        parts = [_search_block(tree.where(part), block, width, kind, k, same, own_slab)
                 for block in _dealt(asks, 8 * width + 512)]
        found = stage(reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "hn-found")
    return found


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor, positive, rank, negative, positive_score, negative_score: per anchor and positive the best rows of other
    labels whose score is between ``low`` and ``high`` percent of the positive's."""
    spark = rows.sparkSession
    kind = rows.schema[label_col].dataType.typeName()
    label = F.col(label_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(label_col)
    clean = rows.where(finite(vec_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), doubles(vec_col).alias("vec"))
    out_type = "anchor bigint, positive bigint, rank int, negative bigint, positive_score bigint, negative_score bigint"
    width, total = usual_width(clean, "vec")
    if not width:
        return spark.createDataFrame([], out_type)
    fits = math.isqrt(_MOST // width)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled_floor(matrix(b.column(3), width), scale, fits).astype(np.float64)
            off = pa.array(np.arange(0, x.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(off, pa.array(x.reshape(-1)))], names=["id", "label", "asks", "vec"])

    whole = stage(clean.where(F.size("vec") == width).mapInArrow(integers, "id bigint, label bigint, asks boolean, vec array<double>"), "hn-rows")
    largest = whole.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    kind = np.float64 if width * largest * largest < 1 << 53 else np.int64  # products and sums are exact in either
    tree = build_tree(whole, width, total)
    anchors = stage(tree.where("asks").groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "vec")).alias("r"))
                    .select("anchor", "r.label", "r.vec"), "hn-anchors")
    slabs = -(-total // SLAB)
    every = anchors.select("anchor", F.lit(0).cast("long").alias("key"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    best = _search(tree, anchors, every, width, kind, positives, True, slabs)
    pairs = stage(best.select("anchor", F.col("id").alias("positive"), F.col("rank").cast("long").alias("key"), F.col("score").alias("positive_score")), "hn-pairs")
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = pairs.select("anchor", "key", F.ceil(score * low / 100).cast("long").alias("low"),
                           F.floor(score * high / 100).cast("long").alias("high")).where("low <= high")
    hard = _search(tree, anchors, windows, width, kind, negatives, False, slabs)
    return hard.join(pairs, ["anchor", "key"]).select("anchor", "positive", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative"),
                                                      "positive_score", F.col("score").alias("negative_score"))
