"""Exact Jaccard join on word n-grams: prefixes extended so that frequent tokens are indexed in combinations.

A document's tokens are the 64-bit hashes of its distinct n-grams (the whole sequence as one if it has fewer words).
At a threshold t a set of n tokens misses at most n - ceil(t n) of them in a partner. Tokens have one global order,
rare ones first, and a class by the number of documents that hold them: class 1 up to the first of ``LEVELS``, class 2
up to the next or, by default, beyond it; classes above 1 are split into parts by hash. A prefix grows until

    sum over parts of max(0, tokens of the part in the prefix - (class - 1)) > n - ceil(t n).

Of two sets that reach t, take the one whose prefix ends first in the order: what it shares with the other lies in
both prefixes, and by the sum at least one part shares as many tokens as its class. So both index one same single token
(class 1), pair (2) or larger combination of a part: no link is missed. A frequent token alone brings nobody together. The
number of parts follows the size band [2^b, 2^(b+1)) so that the sum can always be reached; a set indexes its combinations for its
own band and for that of its largest possible partner, which covers every pair of sizes.

A token's class only has to be the same for every document, so counting is lazy: first all documents show the tokens of
their prefix by hash alone, and tokens shown by more documents than class 1 allows are frequent; for each frequent token that its prefix
passes over, a document shows ``1 + AHEAD`` of the others, until hardly any new token turns frequent. Most tokens are never shuffled. A bounded
prefilter holds the frequent tokens: what it doesn't know is rare; documents without enough rare tokens have the
others' counts joined to them. Where it fills up, more tokens are looked up; the links stay the same.

Candidates are the members of a bucket (one indexed token or combination and a size band). Buckets with the same members
are kept once. Members meet one leader of the bucket first; members still in another component than the bucket's
largest are then compared with all members of other components there: as joined pairs in small buckets; large
buckets that have members in common are taken together and compared in blocks of bounded rows and bytes within tasks,
which return links only (work that grows with the square of members that no link has joined). Pairs are first held against
bitmaps of about four bits a token, which rule most unlike pairs out, and then verified on their full sets.

Null or empty texts have empty sets, linked with nothing. Equal sets are one node. Repeated rows are separate documents
of one set. Ties go to the smallest id; null ids sort last. An empty table gives an empty result. Extra columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import BoundedFilter, Words, as_long, blank_mask, mix, stage, text_slices
from gridload.llm.components import components
from gridload.llm.minhash import set_ids, shingle_sets

#: Documents that may hold a token of class 1, of class 2 and so on; a token of class k is indexed with k - 1 others.
LEVELS = (32,)
#: Turns end when they add no more than this share of frequent tokens; some then stay in class 1.
LATE = 0.01
#: Tokens that a set shows beyond its prefix for each frequent one passed over: looking ahead saves turns, each a pass over the texts.
AHEAD = 4
#: A bucket of over SMALL members is compared in blocks of at most CHUNK members and about CHUNK_BYTES of tokens.
SMALL, CHUNK, CHUNK_BYTES = 24, 256, 4 << 20
#: Bytes of text cut into tokens at once: the arrays of a slice stay in the processor's cache. Rows whose copies are left out at once.
SLICE, ROWS = 1 << 19, 512


def _binary16(ids: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(ids).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, data]).cast(pa.binary())


def _least_common(n, percent: int):
    """Tokens of a set of n that a partner must share: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def parts_of(band: int, percent: int, classes: int) -> dict[int, tuple[int, int]]:
    """Class -> (tokens indexed together, parts) for a size band; the losses stay below what the smallest set met there can spare."""
    smallest = _least_common(1 << band, percent)  # a partner of the band's smallest set
    spare = max(0, _least_common(smallest, percent) - 1)
    each, out = spare // max(1, classes - 1), {}
    for level in range(2, classes + 1):
        k = min(level, each + 1)
        out[level] = (k, max(1, each // max(1, k - 1)))
    return out


def bands_of(n: int, percent: int) -> range:
    """The bands in which a set of n tokens meets its partners."""
    return range(n.bit_length() - 1, max(n, n * 100 // percent).bit_length())


def _salted(band: int, k: int) -> np.uint64:
    """Tells the keys of a band and number of tokens from all others."""
    return np.uint64((band * 8 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@cache
def _picks(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


def combined(tokens: np.ndarray, counts: np.ndarray, n: int, left: int, percent: int, levels: tuple[int, ...]) -> np.ndarray:
    """Bucket keys of a set beyond its known rare tokens: ``left`` more misses to cover with ``tokens`` (sorted)."""
    class_ = 1 + np.searchsorted(levels, counts, side="left")
    few, bands = tokens[class_ == 1][:left], bands_of(n, percent)
    out, left = [mix(few ^ _salted(band, 1)) for band in bands], left - len(few)
    for band in bands if left > 0 else ():
        missing = left
        for level, (k, parts) in parts_of(band, percent, len(levels) + 1).items():
            mine = tokens[class_ == level]
            part = (mix(mine + np.uint64(level)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((mine, part))
            mine, part = mine[order], part[order]
            for group in np.split(mine, np.flatnonzero(np.diff(part)) + 1):
                if missing <= 0 or len(group) < k:
                    continue
                group = group[: missing + k - 1]
                missing -= len(group) - (k - 1)
                picked = group[_picks(len(group), k)]
                key = np.full(len(picked), _salted(band, k), dtype=np.uint64)
                for j in range(k):
                    key = mix(key ^ picked[:, j])
                out.append(key)
    return np.concatenate(out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (hash of id and text), text."""
    return docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("row"), F.col(text_col).alias("text"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """kept (id and text hash), n (set size), node (128-bit set id, null if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = blank_mask()
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1), SLICE):
                flat, bounds = shingle_sets(Words(data, off, mask), k)
                n = np.diff(bounds)
                node = pc.if_else(pa.array(n == 0), pa.scalar(None, pa.binary()), _binary16(set_ids(flat, bounds)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), node], names=["kept", "n", "node"])

    packed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("kept"), F.col(text_col).alias("text"))
    return packed.mapInArrow(run, f"kept {packed.schema['kept'].dataType.simpleString()}, n bigint, node binary")


def _each_set(texts: DataFrame, k: int, may_lead, then, schema: str) -> DataFrame:
    """``then(flat, bounds)`` of each slice's sets, of the rows that may lead their node (others are copies)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = blank_mask()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                t = b.slice(at, ROWS)
                t = t.filter(pa.array(may_lead(t.column(0).to_numpy().view(np.uint64))))
                for _, _, data, off in text_slices(t.column(1), SLICE):
                    yield from then(*shingle_sets(Words(data, off, mask), k))

    return texts.mapInArrow(run, schema)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a prefix of single tokens takes; none for sets that only an equal set can reach."""
    common = _least_common(n, percent)
    return np.where((common == n) & (n * 100 // percent == n), 0, n - common + 1)


def _ranks(among: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each token its place among the marked ones of its set, from 1."""
    run = np.cumsum(among)
    start = np.concatenate(([0], run))[bounds[:-1]]
    return run - np.repeat(start, np.diff(bounds))


def _count_tokens(texts: DataFrame, k: int, percent: int, may_lead, rare: int) -> tuple[DataFrame, BoundedFilter]:
    """token, c: the documents that showed each token, of all tokens that two can have in their prefixes; the frequent ones."""
    spark = texts.sparkSession

    def shown(flat, bounds, need, owner, frequent) -> np.ndarray:
        rank = _ranks(~frequent, bounds)
        passed = np.bincount(owner[frequent & (rank < need[owner])], minlength=len(need))  # frequent tokens before the prefix's end
        return ~frequent & (rank <= (need + AHEAD * passed)[owner])

    def of(turn: int, now, before):
        def run(flat, bounds) -> Iterator[pa.RecordBatch]:
            n, was = np.diff(bounds), np.zeros(len(flat), dtype=bool)
            hot = now(flat) if turn else was
            if turn > 1:
                at = np.flatnonzero(hot)  # what was frequent stays so
                was[at] = before(flat[at])
            if turn:  # only sets with a token that has turned frequent show more
                more = np.bincount(np.repeat(np.arange(len(n)), n)[hot & ~was], minlength=len(n)) > 0
                kept = np.repeat(more, n)
                flat, hot, was, n = flat[kept], hot[kept], was[kept], n[more]
                bounds = np.concatenate(([0], np.cumsum(n)))
            if not len(n):
                return
            need, owner = _needed(n, percent), np.repeat(np.arange(len(n)), n)
            show = shown(flat, bounds, need, owner, hot)
            if turn:
                show &= ~shown(flat, bounds, need, owner, was)
            token, c = np.unique(flat[show], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(token)), pa.array(c)], names=["token", "c"])
        return run

    found, frequent, seen = None, None, 0
    for turn in range(64):
        before, frequent = frequent, None if found is None else BoundedFilter(spark, found.where(F.col("c") > rare), "token")
        new = _each_set(texts, k, may_lead, of(turn, frequent and frequent.tester(), before and before.tester()), "token bigint, c bigint")
        new = new.groupBy("token").agg(F.sum("c").alias("c"))
        # two that show a token in different turns: one of them shows it after the first, so all those are kept
        new = new.where(F.col("c") > 1) if found is None else new.unionByName(found).groupBy("token").agg(F.sum("c").alias("c"))
        found = stage(new, "gj-counts")
        now = found.where(F.col("c") > rare).count()
        if now - seen <= LATE * seen:
            break
        seen = now
    return found, frequent or BoundedFilter(spark, found.where(F.col("c") > rare), "token")


def _index(texts: DataFrame, k: int, percent: int, may_lead, levels: tuple[int, ...]) -> DataFrame:
    """bucket, node, n: every set under its single tokens and combinations; seldom a row twice."""
    counts, frequent = _count_tokens(texts, k, percent, may_lead, levels[0])
    may_repeat, may_be_frequent = BoundedFilter(texts.sparkSession, counts, "token").tester(), frequent.tester()

    def first(flat, bounds) -> Iterator[pa.RecordBatch]:
        n, ids = np.diff(bounds), set_ids(flat, bounds)
        need, owner = _needed(n, percent), np.repeat(np.arange(len(n)), n)
        known = ~may_be_frequent(flat)
        total = np.bincount(owner[known], minlength=len(n))
        single = known & (_ranks(known, bounds) <= need[owner])
        single[np.flatnonzero(single)] = may_repeat(flat[single])
        asks = ~known & (total < need)[owner]
        pick = np.flatnonzero(single | asks)
        at = owner[pick]
        yield pa.RecordBatch.from_arrays([_binary16(ids[at]), pa.array(n[at]), pa.array(as_long(flat[pick])), pa.array(asks[pick]),
                                          pa.array((need - total)[at])], names=["node", "n", "token", "asks", "left"])

    rows = stage(_each_set(texts, k, may_lead, first, "node binary, n bigint, token bigint, asks boolean, left bigint"), "gj-tokens")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, token = b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            low, high = (np.frexp(v.astype(np.float64))[1] - 1 for v in (n, np.maximum(n, n * 100 // percent)))
            for band in range(int(low.min(initial=64)), int(high.max(initial=0)) + 1):
                at = np.flatnonzero((low <= band) & (band <= high))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(mix(token[at] ^ _salted(band, 1)))), b.column(0).take(pa.array(at)), pa.array(n[at])],
                                                 names=["bucket", "node", "n"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, left = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i in range(b.num_rows):
                found = b.column(3).slice(i, 1).flatten()
                token, c = found.field("token").to_numpy().view(np.uint64), found.field("c").to_numpy()
                token, at = np.unique(token, return_index=True)
                keys = np.unique(combined(token, c[at], n[i], left[i], percent, levels))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array([node[i].as_py()] * len(keys), pa.binary()),
                                                  pa.array(np.full(len(keys), n[i]))], names=["bucket", "node", "n"])

    asked = (rows.where("asks").join(counts, "token", "left")
             .groupBy("node", "n", "left").agg(F.collect_list(F.struct("token", F.coalesce("c", F.lit(1)).alias("c"))).alias("found")))  # of one text
    schema = "bucket bigint, node binary, n bigint"
    return (rows.where("not asks").select("node", "n", "token").mapInArrow(single, schema)
            .unionByName(asked.select("node", "n", "left", "found").mapInArrow(rest, schema)))


def _buckets(index: DataFrame) -> DataFrame:
    """bucket, node, n, m (its members): buckets of two or more, one of those with the same members."""
    index = stage(index, "gj-index")
    # sums, not exclusive ors: a row that comes twice must not cancel itself
    prints = [F.sum(part(F.xxhash64("node", F.lit(salt)))).alias(f"f{salt}{side}") for salt in (0, 1)
              for side, part in (("l", lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), ("h", lambda h: F.shiftrightunsigned(h, 32)))]
    same = index.groupBy("bucket").agg(F.count("*").alias("m"), *prints).where(F.col("m") > 1)
    kept = stage(same.groupBy("m", "f0l", "f0h", "f1l", "f1h").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "gj-kept")
    may_stay = BoundedFilter(index.sparkSession, kept, "bucket").tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_stay(b.column(0).to_numpy().view(np.uint64))))

    return stage(index.mapInArrow(run, "bucket bigint, node binary, n bigint").join(kept, "bucket").distinct(), "gj-buckets")


def _of_nodes(texts: DataFrame, k: int, may_lead, nodes: DataFrame, pack, column: str) -> DataFrame:
    """node and ``pack(tokens)`` as binary ``column`` of the sets of ``nodes`` (and few others)."""
    head = F.expr("cast(conv(concat(" + ", ".join(f"substr(hex(node), {2 * i + 1}, 2)" for i in range(7, -1, -1)) + "), 16, -10) as bigint)")
    wanted = BoundedFilter(texts.sparkSession, nodes.select("node").distinct().select(head.alias("h")), "h").tester()

    def run(flat, bounds) -> Iterator[pa.RecordBatch]:
        ids = set_ids(flat, bounds)
        rows = np.flatnonzero((np.diff(bounds) > 0) & wanted(ids[:, 0]))
        if len(rows):
            yield pa.RecordBatch.from_arrays([_binary16(ids[rows]), pa.array([pack(flat[bounds[i]: bounds[i + 1]]) for i in rows], pa.binary())],
                                             names=["node", column])

    return stage(_each_set(texts, k, may_lead, run, f"node binary, {column} binary").groupBy("node").agg(F.first(column).alias(column)), f"gj-{column}")


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit per token by its hash, in a power of two of at least four bits a token."""
    size = max(8, 1 << int(4 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """An upper bound of the tokens that sets of n and m share, from their bitmaps: a bit of one alone is a token of one alone."""
    if len(x) < len(y):
        x, y, n, m = y, x, m, n
    x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    both = x & y
    alone = [int(np.bitwise_count(v ^ both).sum()) for v in (x, y)]
    return min(n - alone[0], m - alone[1])


def _likely(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; n1, n2: sizes) that their bitmaps don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, n, m in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist()):
                shared = most_common(*(np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y)), n, m)
                ok.append(100 * shared >= percent * (n + m - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (bitmaps.select(F.col("node").alias(c), F.col("bits").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n1", "n2").mapInArrow(run, "a binary, b binary"), "gj-likely")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _tokens(values: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in values]


def _common(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """Tokens that x shares with each of ys."""
    flat = np.concatenate(ys)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, ys[:-1])]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _tokens(b.column(2)), _tokens(b.column(3))
            shared = [int(_common(p, [q])[0]) for p, q in zip(x, y)]
            ok = [100 * s >= percent * (len(p) + len(q) - s) for s, p, q in zip(shared, x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("items").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _blocks(open_: DataFrame) -> DataFrame:
    """bucket, node, n, comp, big, m, bytes: large open buckets with members in common taken together, so that members that
    share many buckets meet once."""
    least = open_.groupBy("bucket").agg(F.min("node").alias("a"))
    label = components(open_.join(least, "bucket").select("a", F.col("node").alias("b")).distinct())
    nodes = stage(open_.select("node", "n", "comp").distinct().join(label, "node").withColumnRenamed("label", "bucket"), "gj-together")
    held = nodes.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = held.groupBy("bucket").agg(F.sum("c").alias("m"), (8 * F.sum("s")).alias("bytes"), F.max(F.struct("c", "comp")).alias("top"))
    return nodes.join(whole.select("bucket", "m", "bytes", F.col("top.comp").alias("big")), "bucket")


def _block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components of large buckets: one per asking member and component met."""
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        node, comp = t.column("node").to_pylist(), np.array(t.column("comp").to_pylist(), dtype=object)
        asks, items = t.column("asks").to_numpy(zero_copy_only=False), _tokens(t.column("items").combine_chunks())
        size, order, big = np.array(list(map(len, items))), np.array(node, dtype=object), t.column("big")[0].as_py()
        maps = [np.frombuffer(bitmap(x), dtype=np.uint8) for x in items]
        width, other, links = np.array(list(map(len, maps))), np.flatnonzero(~asks), []
        folded = {}  # (width of the members, width asked for) -> members, their bitmaps folded to it, bits set
        for w in np.unique(width[other]):
            js = other[width[other] == w]
            rows = np.stack([maps[j] for j in js])
            for v in (w, w // 2):
                if v:
                    at = rows if v == w else np.bitwise_or(rows[:, :v], rows[:, v:])
                    folded[int(w), int(v)] = js, at, np.bitwise_count(at).sum(axis=1, dtype=np.int64)
        for i in np.flatnonzero(asks):
            likely = []
            for w in (width[i], 2 * width[i], width[i] // 2):  # sizes that fit are less than twice each other
                v = min(int(w), int(width[i]))
                if (int(w), v) not in folded:
                    continue
                js, rows, bits = folded[int(w), v]
                mine = maps[i] if v == width[i] else np.bitwise_or(maps[i][:v], maps[i][v:])
                both = np.bitwise_count(rows & mine).sum(axis=1, dtype=np.int64)
                most = np.minimum(size[js] - bits + both, size[i] - int(np.bitwise_count(mine).sum()) + both)
                fits = (comp[js] != comp[i]) & ((comp[js] == big) | (order[js] > node[i]))
                likely.append(js[fits & (100 * most >= percent * (size[js] + size[i] - most))])
            js = np.concatenate(likely) if likely else other[:0]
            if len(js):
                shared = _common(items[i], [items[j] for j in js])
                met = js[100 * shared >= percent * (size[js] + size[i] - shared)]
                links += [sorted((node[i], node[j])) for j in {comp[j]: j for j in met}.values()]
        return pa.table([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], names=["a", "b"])

    def deal(key, blocks):
        return F.pmod(F.xxhash64("node", F.lit(key)), blocks).cast("int")

    blocks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    cells = F.sequence(F.lit(0), blocks - 1)
    asking = open_.where("comp != big").withColumn("p", deal(0, blocks)).withColumn("q", F.explode(cells)).withColumn("asks", F.lit(True))
    asked = open_.withColumn("q", deal(1, blocks)).withColumn("p", F.explode(cells)).withColumn("asks", F.lit(False))
    columns = ["bucket", "p", "q", "node", "comp", "big", "asks"]
    dealt = asking.select(columns).unionByName(asked.select(columns)).join(sets, "node")
    return dealt.groupBy("bucket", "p", "q").applyInArrow(run, "a binary, b binary").distinct()


def gram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
              levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Per document row: id, th (text hash), n (set size), component (smallest id reachable over links)."""
    spark = docs.sparkSession
    sizes = stage(_sizes(docs, id_col, text_col, k), "gj-sizes")
    texts = _texts(docs, id_col, text_col)
    ranked = F.struct(F.col("kept.id").isNull().alias("none"), F.col("kept.id").alias("id"), F.col("kept.th").alias("th"))
    nodes = stage(sizes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(ranked).alias("low")), "gj-nodes")
    may_lead = BoundedFilter(spark, nodes.select(F.xxhash64("low.id", "low.th").alias("h")), "h").tester()
    buckets = _buckets(_index(texts, k, percent, may_lead, levels))
    bitmaps = _of_nodes(texts, k, may_lead, buckets, bitmap, "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        likely = _likely(pairs, bitmaps, percent)
        return _verified(likely, _of_nodes(texts, k, may_lead, _both(likely), np.ndarray.tobytes, "items"), percent)

    def ordered(x: str, y: str) -> list:
        first = F.col(f"{x}node") < F.col(f"{y}node")
        return [F.when(first, F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}")).alias(f"{o}")
                for (p, q), c, o in (((x, y), "node", "a"), ((y, x), "node", "b"), ((x, y), "n", "n1"), ((y, x), "n", "n2"))]

    def fits(a, b):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    degree = buckets.groupBy("node").agg(F.sum("m").alias("degree"))
    known = stage(buckets.join(degree, "node"), "gj-degrees")
    leaders = known.groupBy("bucket").agg(F.max(F.struct("degree", "n", "node")).alias("lead"))
    known = known.join(leaders, "bucket").select(F.col("node").alias("xnode"), F.col("n").alias("xn"), F.col("lead.node").alias("ynode"), F.col("lead.n").alias("yn"))
    star = stage(known.where((F.col("xnode") != F.col("ynode")) & fits(F.col("xn"), F.col("yn"))).select(ordered("x", "y")).distinct(), "gj-star")
    links = stage(verified(star), "gj-links")

    placed = stage(buckets.join(components(links), "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"), "gj-placed")
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    several = (held.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("big"))
               .where(F.col("comps") > 1).select("bucket", F.col("big.comp").alias("big")))
    open_ = stage(placed.join(several, "bucket"), "gj-open")
    few = open_.where(F.col("m") <= SMALL)
    x = few.where("comp != big").select("bucket", *[F.col(c).alias(f"x{c}") for c in ("node", "n", "comp")])
    y = few.select("bucket", "big", *[F.col(c).alias(f"y{c}") for c in ("node", "n", "comp")])
    apart = (x.join(y, "bucket").where("xcomp != ycomp and (ycomp = big or xnode < ynode)").where(fits(F.col("xn"), F.col("yn")))
             .select(ordered("x", "y")).distinct().join(star, ["a", "b"], "left_anti"))
    many = _blocks(stage(open_.where(F.col("m") > SMALL).select("bucket", "node", "n", "comp"), "gj-large"))
    more = stage(verified(stage(apart, "gj-apart")).unionByName(
        _block_links(many, _of_nodes(texts, k, may_lead, many, np.ndarray.tobytes, "items"), percent)), "gj-more")
    label = components(links.unionByName(more))

    low = nodes.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    lowest = low.groupBy("comp").agg(F.min("low").alias("first"))
    by_node = low.join(lowest, "comp").select("node", F.col("first.id").alias("component"))
    full, empty = sizes.where(F.col("node").isNotNull()), sizes.where(F.col("node").isNull())
    return (full.join(by_node, "node").select("kept.id", "kept.th", "n", "component")
            .unionByName(empty.select("kept.id", "kept.th", "n", F.col("kept.id").alias("component"))))
