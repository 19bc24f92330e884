"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Index: equal vectors form one node. Every node starts with its best partners among nodes with nearby
random-projection codes; then, in each turn, a node's neighbourhood (its neighbours and a bounded sample of the nodes
that point at it) is joined with itself, and every member keeps the best partners it meets there: neighbours of
neighbours, found by joins. The graph is a staged table after each turn.

Search: each query keeps a beam of its best ``ef`` nodes; per round the best unexpanded ones are joined to the
graph and their neighbours scored by their distance in floats, until the beam is expanded. Every node within float
error of the best ``k`` is ranked by the cosine in double precision, ties to the smaller id. Query vectors are
broadcast in blocks of at most ``BLOCK_BYTES``; each block is searched against the whole graph.

Equal query vectors are searched once. A turn scores only nodes that are not in the beam yet. Graph turns compare 8-bit
codes, which can't tell members of a group of nearly equal vectors apart: queries whose whole beam lies within
``CROWDED`` of their ``k`` best are therefore answered by an exact scan over all nodes, whatever the table's size.

Vectors whose directions agree to twelve decimals count as equal. Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without an id or with
another length than most. Repeated rows are candidates like others, with equal ids listed once
each per row. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import stage

BLOCK_BYTES = 16 << 20
#: Cosines closer than this are not told apart by the graph's 8-bit codes.
CROWDED = 1e-3


def _usable(col: str) -> Column:
    v = F.col(col)
    return (v.isNotNull() & F.exists(v, lambda x: x != 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros((0, width), dtype=dtype)
    off = np.frombuffer(col.buffers()[1], dtype=np.int32 if col.type == pa.binary() else np.int64)[col.offset: col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]: off[-1]].view(dtype).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, off, pa.py_buffer(rows.tobytes())])


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _encode(rows: DataFrame, width: int) -> DataFrame:
    """node, unit (float32 bytes), code (8-bit bytes), proj (random-projection code) from node, vec (doubles)."""
    plane = np.random.default_rng(7).standard_normal((width, 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            code = np.rint(v * 127).astype(np.int8)
            bits = ((u @ plane) > 0).astype(np.int64)
            proj = (bits << np.arange(62, dtype=np.int64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(u.astype(np.float32)), _binary(code), pa.array(proj)],
                                             names=["node", "unit", "code", "proj"])

    return rows.mapInArrow(run, "node bigint, unit binary, code binary, proj bigint")


def _best(sims: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    t = min(t, sims.shape[-1] - 1)
    at = np.argpartition(-sims, t, axis=-1)[..., :t] if t < sims.shape[-1] else np.argsort(-sims, axis=-1)
    return at, np.take_along_axis(sims, at, -1)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], names=["a", "b", "sim"])


def _start(nodes: DataFrame, width: int, trees: int, leaf: int, per_leaf: int) -> DataFrame:
    """First partners: nodes sorted by a few projection bits per tree, compared within leaves of fixed size."""
    bits = 62 // trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while t.num_rows >= 2 * leaf:
                yield from join(t.slice(0, leaf))
                t = t.slice(leaf)
            rest = t
        if rest is not None and rest.num_rows > 1:
            yield from join(rest)

    def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t.column("node").combine_chunks().to_numpy()
        x = _unit(_matrix(t.column("code"), np.int8, width))
        sims = x @ x.T
        sims[ids[:, None] == ids[None, :]] = -9
        at, s = _best(sims, per_leaf)
        ok = s > -5
        yield _edges(np.broadcast_to(ids[:, None], s.shape)[ok], ids[at][ok], s[ok])

    spread = nodes.select("node", "code", F.posexplode(F.array(*[
        F.expr(f"shiftright(proj, {k * bits}) & {(1 << bits) - 1}") for k in range(trees)])).alias("tree", "prefix"))
    return (spread.withColumn("tie", F.xxhash64("node", "tree")).repartitionByRange("tree", "prefix", "tie")
            .sortWithinPartitions("tree", "prefix", "tie").select("node", "code").mapInArrow(run, "a bigint, b bigint, sim float"))


def _keep_best(edges: DataFrame, degree: int) -> DataFrame:
    """node, nbrs (best first), sims, worst (of a full list, else -1) from edges (a, b, sim)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        parts, waiting = [], 0

        def cut():
            nonlocal a, b, s, parts, waiting
            a, b, s = (np.concatenate(x) for x in zip((a, b, s), *parts))
            parts, waiting = [], 0
            order = np.lexsort((b, a))
            a, b, s = a[order], b[order], s[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, s = a[first], b[first], s[first]
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            ok = rank < degree
            a, b, s = a[ok], b[ok], s[ok]

        for x in batches:  # the lists are cut as rows come, so memory follows the nodes, not the edges
            parts.append([x.column(i).to_numpy() for i in range(3)])
            waiting += x.num_rows
            if waiting > max(1 << 20, 2 * len(a)):
                cut()
        cut()
        if not len(a):
            return
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        off = np.append(starts, len(a)).astype(np.int32)
        worst = np.where(np.diff(off) >= degree, s[off[1:] - 1], np.float32(-1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[starts]), pa.ListArray.from_arrays(pa.array(off), pa.array(b)),
             pa.ListArray.from_arrays(pa.array(off), pa.array(s)), pa.array(worst.astype(np.float32))],
            names=["node", "nbrs", "sims", "worst"])

    return edges.repartition("a").mapInArrow(run, "node bigint, nbrs array<bigint>, sims array<float>, worst float")


def _neighbourhoods(graph: DataFrame, size: int, seed: int) -> DataFrame:
    """v, m: each node's neighbours and, up to ``size`` members in all, a random sample of the nodes that point at it."""
    ahead = graph.select(F.col("node").alias("v"), F.posexplode("nbrs").alias("p", "m"))
    rank = F.least(F.col("p"), F.lit(size)).cast("long")
    back = ahead.select(F.col("m").alias("v"), F.col("v").alias("m"),
                        (F.lit(size) + F.pmod(F.xxhash64("m", "v", F.lit(seed)), F.lit(1 << 40))).alias("rank"))
    w = Window.partitionBy("v").orderBy("rank", "m")
    return (ahead.select("v", "m", rank.alias("rank")).unionByName(back.select("v", "m", "rank"))
            .withColumn("at", F.row_number().over(w)).where(F.col("at") <= size).select("v", "m").distinct())


def _descend(graph: DataFrame, nodes: DataFrame, width: int, size: int, partners: int, seed: int) -> DataFrame:
    """One turn: better edges (a, b, sim) found in the neighbourhoods."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                col = batch.column(0).slice(lo, 1000)
                count = np.asarray(pc.list_value_length(col))
                flat = col.flatten()
                ids, worst = flat.field("m").to_numpy(), flat.field("worst").to_numpy()
                x = _unit(_matrix(flat.field("code"), np.int8, width))
                top = int(count.max())
                row = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
                member = np.full((len(count), top), -1, np.int64)
                low = np.full((len(count), top), 9, np.float32)
                vec = np.zeros((len(count), top, width), np.float32)
                member[row, at], low[row, at], vec[row, at] = ids, worst, x
                sims = np.matmul(vec, vec.transpose(0, 2, 1))
                sims[:, np.arange(top), np.arange(top)] = -9
                sims[np.broadcast_to((member < 0)[:, None, :], sims.shape)] = -9
                sims[sims <= low[:, :, None]] = -9
                if top < 2:
                    continue
                best, s = _best(sims, partners)
                ok = s > -5
                a = np.broadcast_to(member[:, :, None], s.shape)[ok]
                b = np.take_along_axis(np.broadcast_to(member[:, None, :], sims.shape), best, 2)[ok]
                yield _edges(a, b, s[ok])

    member = nodes.select(F.col("node").alias("m"), "code").join(graph.select(F.col("node").alias("m"), "worst"), "m")
    local = (_neighbourhoods(graph, size, seed).join(member, "m")
             .groupBy("v").agg(F.collect_list(F.struct("m", "code", "worst")).alias("members")))  # at most `size` each
    return local.select("members").mapInArrow(run, "a bigint, b bigint, sim float")


def build_graph(nodes: DataFrame, width: int, degree: int = 24, size: int = 48, partners: int = 5, turns: int = 6,
                least_change: float = 0.002) -> DataFrame:
    """The NN-descent graph: node, nbrs, sims, worst. Stops early when a turn improves few edges."""
    graph = stage(_keep_best(_start(nodes, width, trees=6, leaf=64, per_leaf=8), degree), "ann-start")
    for turn in range(turns):
        better = _descend(graph, nodes, width, size, partners, turn)
        old = graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("a", "e.nbrs", "e.sims")
        new = stage(_keep_best(better.unionByName(old.toDF("a", "b", "sim")), degree), "ann-turn")
        gain = new.agg(F.sum(F.aggregate("sims", F.lit(0.0), lambda x, s: x + s)).alias("s"), F.sum(F.size("sims")).alias("n")).first()
        was = graph.agg(F.sum(F.aggregate("sims", F.lit(0.0), lambda x, s: x + s)).alias("s")).first()["s"] or 0.0
        graph = new
        if not gain["n"] or gain["s"] - was < least_change * gain["n"] * 0.1:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, width: int, k: int, ef: int = 400, step: int = 64,
           back: int = 24) -> DataFrame:
    """query, node, crowded: the nodes of each query's beam within float error of its ``k`` + 1 best, and whether the
    whole beam is nearly as near. ``queries``: query, node (its own)."""
    spark = queries.sparkSession
    ahead = graph.select("node", F.explode("nbrs").alias("nbr"))
    pointing = (graph.select(F.explode(F.arrays_zip("nbrs", "sims")).alias("e"), F.col("node").alias("nbr"))
                .select(F.col("e.nbrs").alias("node"), "nbr", F.col("e.sims").alias("sim")))
    near = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    pointing = pointing.withColumn("at", F.row_number().over(near)).where(F.col("at") <= back).select("node", "nbr")
    links = stage(ahead.union(pointing).distinct().groupBy("node").agg(F.collect_list("nbr").alias("nbrs")), "ann-links")
    own = queries.join(nodes.select("node", "unit"), "node").select("query", "node", "unit")
    out = None
    for block in _blocks(own, 4 * width):
        found = _search_block(spark, block, links, nodes, width, k, ef, step)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(own: DataFrame, row_bytes: int) -> list[DataFrame]:
    """The rows by hash in blocks of at most ``BLOCK_BYTES``; the sizes are checked before anything is broadcast."""
    most, total = max(1, BLOCK_BYTES // row_bytes), own.count()
    parts = max(1, -(-5 * total // (4 * most)))
    while True:
        dealt = own.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(parts)))
        if (dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        parts *= 2
    dealt = stage(dealt, "ann-queries")
    return [dealt.where(F.col("block") == block) for block in range(parts)]


def _scan(own: DataFrame, names: DataFrame, width: int, k: int) -> DataFrame:
    """query, node, sim: the exact ``k`` + 1 nearest nodes of each query. ``own``: query, vec; ``names``: node, vec."""
    best, out = Window.partitionBy("query").orderBy(F.desc("sim"), "node"), None
    for block in _blocks(own, 8 * width):
        found = _scan_block(block, names, width, k)
        found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
        out = found if out is None else out.unionByName(found)
    return out


def _scan_block(own: DataFrame, names: DataFrame, width: int, k: int) -> DataFrame:
    def units(col) -> np.ndarray:
        v = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    rows = own.select("query", "vec").toArrow()
    shared = own.sparkSession.sparkContext.broadcast((rows.column("query").to_numpy(), units(rows.column("vec").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, unit = shared.value
        q, n, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        low = np.full(len(asked), -2.0)  # the worst of a full list
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, x = part.column(0).to_numpy(), units(part.column(1))
                parts = [(q, n, s)]
                for lo in range(0, len(asked), 1024):
                    sims = unit[lo: lo + 1024] @ x.T
                    bar = low[lo: lo + 1024]
                    if len(ids) > k + 1:
                        bar = np.maximum(bar, np.partition(sims, -(k + 1), axis=1)[:, -(k + 1)])
                    r, c = np.nonzero(sims >= bar[:, None])
                    parts.append((r + lo, ids[c], sims[r, c]))
                q, n, s = (np.concatenate(p) for p in zip(*parts))
                order = np.lexsort((n, -s, q))
                q, n, s = q[order], n[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                ok = rank <= k
                low[q[rank == k]] = s[rank == k]
                q, n, s = q[ok], n[ok], s[ok]
        yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(n), pa.array(s)], names=["query", "node", "sim"])

    return names.select("node", "vec").mapInArrow(run, "query bigint, node bigint, sim double")


def _search_block(spark, own: DataFrame, links: DataFrame, nodes: DataFrame, width: int, k: int, ef: int, step: int) -> DataFrame:
    rows = own.select("query", "unit").distinct().toArrow()
    order = np.argsort(rows.column("query").to_numpy(), kind="stable")
    names = rows.column("query").to_numpy()[order]
    shared = spark.sparkContext.broadcast((names, _matrix(rows.column("unit"), np.float32, width)[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit = shared.value
        for b in batches:
            q = b.column(0).to_numpy()
            x = _matrix(b.column(2), np.float32, width)
            gap = unit[np.searchsorted(known, q)] - x  # of near vectors the difference is exact, a product isn't
            s = -0.5 * np.einsum("ij,ij->i", gap, gap)  # the cosine less one
            ok = s > b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(b.column(1).to_numpy()[ok]), pa.array(s[ok])],
                                             names=["query", "node", "sim"])

    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    beam = stage(own.select("query", "node", F.lit(0.0).cast("float").alias("sim"), F.lit(0).alias("done"), F.lit(1).alias("at"),
                            F.lit(-3.0).cast("float").alias("bar")).distinct(), "ann-beam")
    while True:
        turn = Window.partitionBy("query").orderBy("at")
        front = beam.where("done = 0").withColumn("k", F.row_number().over(turn)).where(F.col("k") <= step)
        if front.isEmpty():
            break
        pairs = (front.select("query", "node", "bar").join(links, "node").select("query", "bar", F.explode("nbrs").alias("node")).distinct())
        pairs = pairs.join(beam.select("query", "node"), ["query", "node"], "left_anti")
        fresh = (pairs.join(nodes.select("node", "unit"), "node").select("query", "node", "unit", "bar")
                 .mapInArrow(score, "query bigint, node bigint, sim float"))
        step_done = F.least(F.lit(1), F.col("done") + F.when((F.col("done") == 0) & (F.col("k") <= step), 1).otherwise(0))
        old = beam.withColumn("k", F.row_number().over(Window.partitionBy("query", "done").orderBy("at"))).select(
            "query", "node", "sim", step_done.alias("done"))
        merged = (old.unionByName(fresh.withColumn("done", F.lit(0))).groupBy("query", "node")
                  .agg(F.max("sim").alias("sim"), F.max("done").alias("done")).withColumn("at", F.row_number().over(best))
                  .where(F.col("at") <= ef))
        bar = F.when(F.count("*").over(Window.partitionBy("query")) >= ef, F.min("sim").over(Window.partitionBy("query"))).otherwise(-3.0)
        beam = stage(merged.withColumn("bar", bar.cast("float")), "ann-beam")
    whole, sim = Window.partitionBy("query"), F.col("sim").cast("double")
    last = F.max(F.when(F.col("at") == k + 1, sim)).over(whole)
    error = 2e-5 * F.abs(last) + 2e-7 * F.sqrt(2 * F.abs(last)) + 1e-13
    return (beam.withColumn("crowded", (F.max("at").over(whole) >= ef) & (F.min(sim).over(whole) >= last - CROWDED))
            .withColumn("least", last - error).where(F.col("least").isNull() | (sim >= F.col("least")))
            .select("query", "node", "crowded"))


def _candidates(asking: DataFrame, graph: DataFrame, nodes: DataFrame, names: DataFrame, width: int, k: int, ef: int = 400,
                step: int = 64, back: int = 24) -> DataFrame:
    """asked, node: the candidates of each asked node; an exact scan answers those whose beam is crowded."""
    asked = asking.select(F.col("node").alias("query"), "node").distinct()
    found = stage(search(asked, graph, nodes, width, k, ef=ef, step=step, back=back), "ann-found")
    crowded = found.where("crowded").select("query").distinct()
    exact = names.join(crowded, names["node"] == crowded["query"], "left_semi").select(F.col("node").alias("query"), "vec")
    scanned = _scan(exact, names, width, k)
    return stage(found.join(crowded, "query", "left_anti").select("query", "node").unionByName(scanned.select("query", "node"))
                 .select(F.col("query").alias("asked"), "node"), "ann-candidates")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            **options) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest rows found for each row that ``is_query`` marks, itself left out."""
    clean = stage(vectors.where(_usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"),
        is_query.alias("asks")), "ann-vectors")
    first = clean.select(F.size("vec").alias("n")).groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    empty = "query_id bigint, rank int, id bigint, score double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width = first["n"]
    clean = clean.where(F.size("vec") == width)
    most = F.array_max(F.transform("vec", F.abs))
    same = F.transform("vec", lambda x: F.rint(x / most * 1e12).cast("long"))
    clean = stage(clean.withColumn("same", F.struct(F.xxhash64(same).alias("h1"), F.hash(same).alias("h2"))), "ann-keyed")
    ranked = clean.withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy("id")))
    # of equal vectors, only the k+1 smallest ids can be among anyone's k nearest
    heads = stage(ranked.where(F.col("at") <= k + 1).select("same", "id", "vec", "at"), "ann-heads")
    names = heads.where("at = 1").select("same", F.col("id").alias("node"), "vec")
    nodes = stage(_encode(names.select("node", "vec"), width), "ann-nodes")
    graph = build_graph(nodes, width, **{x: v for x, v in options.items() if x in ("degree", "size", "partners", "turns")})
    asking = stage(clean.where(F.col("asks")).dropDuplicates(["id"]).select("same", F.col("id").alias("query"), F.col("vec").alias("qvec"))
                   .join(names.select("same", "node"), "same").select("query", "node", F.col("qvec").alias("vec")), "ann-asking")
    found = _candidates(asking, graph, nodes, names, width, k, **{x: v for x, v in options.items() if x in ("ef", "step", "back")})
    members = heads.select("same", "id").join(names, "same").select("node", "id", "vec")
    found = found.join(asking.select(F.col("node").alias("asked"), "query"), "asked").drop("asked")
    asked = asking.select("query", F.col("vec").alias("qvec"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    score = dot(F.col("vec"), F.col("qvec")) / (F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(F.col("qvec"), F.col("qvec"))))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (found.join(members, "node").where(F.col("id") != F.col("query")).join(asked, "query").withColumn("score", score)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", "id", "score"))
