"""Fuzzy linkage of two name lists (J13, greedy one-to-one, A12) and the name scorers.

Score (J13): names lower-cased; ``simple = 100·(1 − lev/max(len))``;
``partial = 100`` when one name contains the other, else ``simple``;
``score = (simple + partial) / 2``; accepted at ≥ 80.

Candidates come from an exact index instead of blocking, so no accepted
pair is lost and no block emits all its pairs. For an acceptance score T
(80 by default) let ``e = 1 − T/100``:

* without containment a pair needs ``lev ≤ e·max(len)``; then the lengths
  differ by at most ``e·max``, and with ``k = ⌊e/(1−e)·len⌋`` for the indexed
  name, cutting it into ``k + 1`` segments leaves at least one segment intact
  in the other name, shifted by at most ``k`` positions (pigeonhole, as in the
  Pass-Join algorithm). The index holds the segments; probes are the
  substrings of the other name at those lengths and positions;
* with containment the shorter name is a substring of the longer one covering
  at least ``(2T − 100)`` % of it, found by a substring index.

Short names are indexed by their deletion neighbourhoods (``≤ k`` deletions:
tight, shared only by near names); names past a length band where that
neighbourhood would exceed ~6000 strings switch to the segment index, which
grows polynomially. Partners differ in length by at most ``1/(1−e)``, so the
overlap of the two bands covers every pair. Both are equi-joins on generated
keys, sized for names (identifiers, headers, entity names), not for long texts.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Tp

from ..functions import columns as C
from ..functions import constants as K
from ..session import scratch_path
from .letters import pairs_above

ACCEPT = K.LEV_ACCEPT


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """Even partition of a length-``n`` name into ``k + 1`` segments: (start, length)."""
    parts = k + 1
    short, extra = divmod(n, parts)
    out, pos = [], 0
    for i in range(parts):
        ln = short + (1 if i >= parts - extra else 0)
        out.append((pos, ln))
        pos += ln
    return out


def _edit_budget(n: int, e: float) -> int:
    """Largest edit count a partner of an indexed name of length ``n`` may need."""
    return int(e / (1.0 - e) * n + 1e-9)


def _segment_keys(s: str, e: float) -> list[str]:
    n = len(s)
    k = _edit_budget(n, e)
    return sorted({f"{n}|{i}|{s[p:p + ln]}" for i, (p, ln) in enumerate(_segments(n, k))})


def _probe_keys(s: str, e: float) -> list[str]:
    m = len(s)
    lo = int(m * (1.0 - e) - 1e-9) if m else 0
    hi = int(m / (1.0 - e) + 1e-9)
    keys = set()
    for n in range(max(0, lo), hi + 1):
        k = _edit_budget(n, e)
        if abs(n - m) > k:
            continue
        for i, (p, ln) in enumerate(_segments(n, k)):
            for q in range(max(0, p - k), min(m - ln, p + k) + 1):
                keys.add(f"{n}|{i}|{s[q:q + ln]}")
    return sorted(keys)


def _deletions(s: str, k: int) -> list[str]:
    """Every string reachable from ``s`` by at most ``k`` deletions."""
    level, out = {s}, {s}
    for _ in range(k):
        level = {x[:i] + x[i + 1:] for x in level for i in range(len(x))}
        out |= level
    return sorted(out)


def _deletion_band(e: float, max_variants: int = 6000) -> int:
    """Longest name length whose deletion neighbourhood stays within ``max_variants``."""
    from math import comb

    n = 0
    while True:
        k = _edit_budget(n + 1, e)
        if sum(comb(n + 1, i) for i in range(k + 1)) > max_variants:
            return n
        n += 1


def _edit_keys(s: str, e: float, probe: bool) -> list[str]:
    """Exact edit-path keys, banded by length: short names use deletion neighbourhoods
    (tight), long names use the segment/probe index (polynomial). Partners differ in length
    by at most a factor 1/(1−e), so the overlap of the bands covers every pair."""
    d = _deletion_band(e)
    p = int(d * (1.0 - e))
    n = len(s)
    keys = []
    if n <= d:
        keys += ["d|" + v for v in _deletions(s, _edit_budget(n, e))]
    if n >= p:
        keys += ["s|" + x for x in (_probe_keys(s, e) if probe else _segment_keys(s, e))]
    return keys


def _substrings(s: str, frac: float) -> list[str]:
    n = len(s)
    lo = max(1, -int(-frac * n // 1)) if frac > 0 else 1
    return sorted({s[i:i + m] for m in range(lo, n + 1) for i in range(0, n - m + 1)})


def _index_udfs(threshold: float):
    e = 1.0 - threshold / 100.0
    frac = max(0.0, (2.0 * threshold - 100.0) / 100.0)

    @F.pandas_udf(Tp.ArrayType(Tp.StringType()))
    def segment_keys(names: pd.Series) -> pd.Series:
        return names.map(lambda x: _edit_keys(x, e, probe=False) if isinstance(x, str) else [])

    @F.pandas_udf(Tp.ArrayType(Tp.StringType()))
    def probe_keys(names: pd.Series) -> pd.Series:
        return names.map(lambda x: _edit_keys(x, e, probe=True) if isinstance(x, str) else [])

    @F.pandas_udf(Tp.ArrayType(Tp.StringType()))
    def substring_keys(names: pd.Series) -> pd.Series:
        return names.map(lambda x: _substrings(x, frac) if isinstance(x, str) else [])

    return segment_keys, probe_keys, substring_keys


def lev_score(a: Column, b: Column) -> Column:
    """J13 score of two (lower-cased) names on a 0-100 scale."""
    la, lb = F.char_length(a), F.char_length(b)
    simple = 100.0 * (1.0 - F.levenshtein(a, b) / F.greatest(la, lb, F.lit(1)))
    partial = F.when(F.instr(b, a) > 0, 100.0).when(F.instr(a, b) > 0, 100.0).otherwise(simple)
    return (simple + partial) / 2.0


def candidates(left: DataFrame, right: DataFrame, lid: str, lname: str, rid: str, rname: str,
               threshold: float = ACCEPT) -> DataFrame:
    """Every (left, right) pair that can reach ``threshold`` (50-100), with its score."""
    if not 50 <= threshold <= 100:
        raise ValueError("the exact candidate index needs an acceptance score between 50 and 100")
    segment_keys, probe_keys, substring_keys = _index_udfs(threshold)
    lft = left.select(F.col(lid).alias("lid"), F.lower(F.col(lname)).alias("a"))
    rgt = right.select(F.col(rid).alias("rid"), F.lower(F.col(rname)).alias("b"))
    ld = lft.select("lid", "a", F.explode(probe_keys("a")).alias("k"))
    rd = rgt.select("rid", "b", F.explode(segment_keys("b")).alias("k"))
    by_edit = ld.join(rd, "k").select("lid", "a", "rid", "b")
    rs = rgt.select("rid", "b", F.explode(substring_keys("b")).alias("a_key"))
    in_right = lft.join(rs, lft["a"] == rs["a_key"]).select("lid", "a", "rid", "b")
    ls = lft.select("lid", "a", F.explode(substring_keys("a")).alias("b_key"))
    in_left = ls.join(rgt, ls["b_key"] == rgt["b"]).select("lid", "a", "rid", "b")
    pairs = by_edit.unionByName(in_right).unionByName(in_left).distinct()
    return pairs.withColumn("score", lev_score(F.col("a"), F.col("b")))


def best_match(left: DataFrame, right: DataFrame, lid: str, lname: str, rid: str, rname: str,
               threshold: float = ACCEPT) -> DataFrame:
    """J13 (many-to-one): for each left name the best right name with score ≥ threshold
    (ties → lowest right id); unmatched left names get no target and confidence 0."""
    cand = candidates(left, right, lid, lname, rid, rname, threshold).filter(F.col("score") >= threshold)
    w = Window.partitionBy("lid").orderBy(F.col("score").desc(), F.col("rid"))
    best = cand.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    out = left.select(F.col(lid).alias("lid"), F.col(lname).alias("left_name")).join(
        best.select("lid", "rid", "score"), "lid", "left")
    return out.select(F.col("lid").alias("left_id"), "left_name", F.col("rid").alias("right_id"),
                      F.round(F.coalesce(F.col("score"), F.lit(0.0)) / 100.0, 6).alias("confidence"))


# -- greedy one-to-one ----------------------------------------------------------------


def assign(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one choice from scored pairs (lid, rid, score): sources in id order take their best
    free target (ties: lowest rid).

    The same result as rounds of offers: every source offers to its best target that hasn't refused it, a
    target keeps the lowest source and refuses the others (and with them every later source). Since all
    targets rank sources alike, the outcome is that of the sequential choice, with no component or group
    in one task. Rounds end when nobody is refused; each is a staged table.
    """
    spark = pairs.sparkSession

    def staged(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "assign")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    best = Window.partitionBy("lid").orderBy(F.col("score").desc(), F.col("rid"))
    live = staged(pairs.select("lid", "rid", "score").distinct())
    while True:
        offers = live.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
        holds = staged(offers.groupBy("rid").agg(F.min("lid").alias("holder"), F.count(F.lit(1)).alias("offers")))
        if holds.filter("offers > 1").isEmpty():
            return staged(offers)
        contested = holds.filter("offers > 1").select("rid", "holder")
        live = staged(live.join(contested, "rid", "left").filter(F.col("holder").isNull() | (F.col("lid") <= F.col("holder")))
                      .select("lid", "rid", "score"))


def greedy_match(left: DataFrame, right: DataFrame, lid: str, lname: str, rid: str, rname: str,
                 threshold: float = ACCEPT) -> DataFrame:
    """J13 greedy one-to-one: left names in id order each take their best still-free right
    name (first best wins ties)."""
    cand = candidates(left, right, lid, lname, rid, rname, threshold).filter(F.col("score") >= threshold)
    out = left.select(F.col(lid).alias("lid"), F.col(lname).alias("left_name")).join(assign(cand), "lid", "left")
    return out.select(F.col("lid").alias("left_id"), "left_name", F.col("rid").alias("right_id"),
                      F.round(F.coalesce(F.col("score"), F.lit(0.0)) / 100.0, 6).alias("confidence"))


def match_stats(matches: DataFrame, conf: str = "confidence") -> DataFrame:
    """Totals, high (≥ .85), medium [.7, .85), low (0, .7), their rates, mean confidence."""
    c = F.col(conf)
    s = matches.agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.count_if(c >= K.MATCH_HIGH).alias("high_confidence"),
        F.count_if((c >= K.MATCH_MEDIUM) & (c < K.MATCH_HIGH)).alias("medium_confidence"),
        F.count_if((c > 0) & (c < K.MATCH_MEDIUM)).alias("low_confidence"),
        F.count_if(c > 0).alias("mapped"),
        F.round(F.avg(c), 6).alias("mean_confidence"))
    tot = F.col("total_mappings")
    return s.select("*", *[F.round(F.try_divide(F.col(x), tot), 6).alias(f"{x}_rate")
                           for x in ["high_confidence", "medium_confidence", "low_confidence", "mapped"]])


# -- F10/F11 name scorers -------------------------------------------------------------------


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-integer step per character of ``b``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        met = free & at.get(ch, 0)
        free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> int:
    """Indel-based similarity 0-100 (``2·LCS / (len a + len b)``), rounded."""
    if not a and not b:
        return 100
    return int(round(100.0 * 2 * _lcs(a, b) / (len(a) + len(b))))


def partial_ratio(a: str, b: str) -> int:
    """Best ``ratio`` of the shorter name against the windows of its length in the longer one; a window
    may be cut off at the longer name's end."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 0
    return max(ratio(s, t[i:i + len(s)]) for i in range(len(t)))


def _tokens(name: str) -> list[str]:
    """Lower-cased words, everything else being a separator, as the token scorers clean their input."""
    return re.sub(r"\W", " ", name).lower().split()


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(_tokens(a))), " ".join(sorted(_tokens(b))))


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(_tokens(a)), set(_tokens(b))
    common = " ".join(sorted(x & y))
    with_x, with_y = (f"{common} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    best = ratio(with_x, with_y)
    return max(best, ratio(common, with_x), ratio(common, with_y)) if common else best


def pattern_bonus(a: Column, b: Column) -> Column:
    """a family both names hit adds the full bonus and ends the scan; a family only one hits adds the small
    bonus; a close length adds a little more; the total is capped."""
    def hit(c: Column, words) -> Column:
        return c.rlike("|".join(words))

    hits = F.array(*[F.when(hit(a, words) & hit(b, words), 2).when(hit(a, words) | hit(b, words), 1).otherwise(0)
                     for _, words in K.PATTERN_FAMILIES])
    first = F.array_position(hits, 2).cast("int")  # 0: no family in both
    before = F.when(first > 0, F.slice(hits, 1, F.greatest(first - 1, F.lit(0)))).otherwise(hits)
    families = (F.size(F.filter(before, lambda x: x == 1)) * float(K.BONUS_ONE)
                + F.when(first > 0, float(K.BONUS_BOTH)).otherwise(0.0))
    gap = F.abs(F.char_length(a) - F.char_length(b))
    near = F.when(gap <= 2, float(K.BONUS_GAP_2)).when(gap <= 5, float(K.BONUS_GAP_5)).otherwise(0.0)
    return F.least(F.lit(float(K.BONUS_CAP)), families + near)


# -- J14-J18: linkage of names by scorers without an index -----------------------------------
#
# J14, J15 and J17 score only the pairs whose common letters allow the floor (see ``letters``). Names for which J14 and J15
# report a best score though nothing reaches it are looked up again under lower floors. J16 and J18 score every
# distinct source name against every distinct target name, in blocks of bounded size.

BLOCK_NAMES = 256

_SCORED = Tp.StructType([
    Tp.StructField("hits", Tp.ArrayType(Tp.StructType([Tp.StructField("target", Tp.StringType()), Tp.StructField("score", Tp.DoubleType())]))),
    Tp.StructField("best", Tp.DoubleType())])


def _score_blocks(left: DataFrame, right: DataFrame, score, floor: float) -> tuple[DataFrame, DataFrame]:
    """(name, target, score) of all pairs at or above ``floor``, and (name, best) over all targets.

    ``left`` has name and key, ``right`` target and tkey (both distinct); ``score(key, tkey)`` is a Python function.
    """
    blocks = max(1, -(-right.count() // BLOCK_NAMES))
    dealt = (right.groupBy(F.pmod(F.xxhash64("target"), F.lit(blocks)).alias("block"))
             .agg(F.collect_list("target").alias("targets"), F.collect_list("tkey").alias("tkeys")))

    @F.pandas_udf(_SCORED)
    def run(keys: pd.Series, targets: pd.Series, tkeys: pd.Series) -> pd.DataFrame:
        hits, best = [], []
        for key, names, others in zip(keys, targets, tkeys):
            scores = [float(score(key, x)) for x in others]
            hits.append([{"target": t, "score": v} for t, v in zip(names, scores) if v >= floor])
            best.append(max(scores))
        return pd.DataFrame({"hits": hits, "best": best})

    met = (left.filter(F.col("key").isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
           .join(dealt, "block").select("name", run("key", "targets", "tkeys").alias("s")))
    path = scratch_path(left.sparkSession, "scored")
    met.write.parquet(path)
    met = left.sparkSession.read.schema(met.schema).parquet(path)
    return (met.select("name", F.explode("s.hits").alias("h")).select("name", "h.target", "h.score"),
            met.groupBy("name").agg(F.max("s.best").alias("best")))


def _names(df: DataFrame, col: str, key: Column, name: str = "name", key_name: str = "key") -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(F.col(col).alias(name), key.alias(key_name)).distinct()


def _indel_bound(n, m, c, least, most):
    """Greatest ``ratio`` of names of n and m letters with c in common."""
    return 200.0 * c / most(n + m, n * 0 + 1)


def _partial_bound(n, m, c, least, most):
    """Greatest ``partial_ratio``: a full window has c of the shorter name's letters, a cut-off one as many letters as it has."""
    return 200.0 * c / most(least(n, m) + c, n * 0 + 1)


def _scored(pairs: DataFrame, score) -> DataFrame:
    """name, target, score of candidate pairs by a Python scorer, over Arrow batches."""
    @F.pandas_udf(Tp.DoubleType())
    def run(keys: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([float(score(x, y)) for x, y in zip(keys, others)], dtype="float64")

    return pairs.select("name", "target", "key", "tkey", run("key", "tkey").alias("score"))


#: Steps by which the floor falls for names whose best score is still unknown.
FLOOR_STEP = 30.0


def weighted_link(left: DataFrame, right: DataFrame, lid: str, lname: str, rname: str,
                  weights=K.LINK_WEIGHTS, threshold: float = K.LINK_ACCEPT, bonus: bool = True,
                  normalise: bool = True, one_to_one: bool = True) -> DataFrame:
    """J14 (J15 with other weights/threshold, no bonus, lower-cased names instead of the full
    normalisation): keep targets at or above the threshold; then the best target per source (``one_to_one=False``) or
    the greedy one-to-one assignment in source-id order (first best wins ties, in target order).
    ``match_type`` is exact (≥ 85) or fuzzy; ``best_score`` is the best score over all targets,
    reported also for unmatched names (with ``bonus``: before the bonus, or the accepted one if higher).

    Candidates are the pairs whose common letters allow the threshold less the largest bonus the two names can get;
    a name of no pattern family and its likes get at most the bonus for close lengths. The best score of names without
    a scored pair is found under floors that fall by ``FLOOR_STEP``: each turn takes only the names still open.
    """
    w1, w2, w3, w4 = weights
    clean = (lambda c: C.normalize_name(c)) if normalise else (lambda c: F.lower(F.col(c)))
    spark = left.sparkSession

    def score(a: str, b: str) -> float:
        return ratio(a, b) * w1 + partial_ratio(a, b) * w2 + token_sort_ratio(a, b) * w3 + token_set_ratio(a, b) * w4

    def bound(n, m, c, least, most):
        # a cleaned name is one word or none: both token scorers are its ratio, or 100 between two empty names
        tokens = (w3 + w4) * (_indel_bound(n, m, c, least, most) if normalise else 100.0)
        return (w1 * _indel_bound(n, m, c, least, most) + w2 * _partial_bound(n, m, c, least, most) + tokens) + 0.5 * (w1 + w2 + w3 + w4)

    def staged(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "scored")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    words = "|".join(w for _, ws in K.PATTERN_FAMILIES for w in ws)
    sources, targets = staged(_names(left, lname, clean(lname)).dropna()), staged(_names(right, rname, clean(rname), "target", "tkey").dropna())
    if bonus:
        plain, tplain = ~F.col("key").rlike(words), ~F.col("tkey").rlike(words)
        near, full = threshold - K.BONUS_GAP_2, threshold - K.BONUS_CAP
        pairs = (pairs_above(sources.filter(plain), targets.filter(tplain), bound, near)
                 .unionByName(pairs_above(sources.filter(plain), targets.filter(~tplain), bound, full))
                 .unionByName(pairs_above(sources.filter(~plain), targets, bound, full)))
    else:
        pairs = pairs_above(sources, targets, bound, threshold)
    empty = sources.filter("key = ''").join(targets.filter("tkey = ''"), F.col("key") == F.col("tkey"))  # all of them reach 80
    scored = staged(_scored(pairs.unionByName(empty.select("name", "key", "target", "tkey")).distinct(), score))
    hits = scored.select("name", "target", (F.col("score") + pattern_bonus(F.col("key"), F.col("tkey")) if bonus else F.col("score")).alias("score"))
    hits = hits.select("name", "target", F.least(F.lit(100.0), F.col("score")).alias("score")).filter(F.col("score") >= threshold)

    # a scored pair at or above its floor is above every pair that wasn't scored
    floor = threshold - (K.BONUS_GAP_2 if bonus else 0)
    best_any = scored.groupBy("name").agg(F.max("score").alias("best")).filter(F.col("best") >= floor)
    while floor > 0:
        floor = max(0.0, floor - FLOOR_STEP)
        rest = staged(sources.join(best_any, "name", "left_anti"))
        if rest.isEmpty():
            break
        more = (_scored(pairs_above(rest, targets, bound, floor), score).groupBy("name").agg(F.max("score").alias("best"))
                .filter(F.col("best") >= floor))
        best_any = staged(best_any.unionByName(more))
    base = left.select(F.col(lid).alias("lid"), F.col(lname).alias("left_name"))
    pairs = base.join(hits, F.col("left_name") == F.col("name")).select("lid", F.col("target").alias("rid"), "score")
    if one_to_one:
        chosen = assign(pairs)
    else:
        win = Window.partitionBy("lid").orderBy(F.col("score").desc(), F.col("rid"))
        chosen = pairs.withColumn("_rn", F.row_number().over(win)).filter("_rn = 1").drop("_rn")
    out = base.join(chosen, "lid", "left").join(best_any.withColumnRenamed("name", "left_name"), "left_name", "left")
    return out.select(
        F.col("lid").alias("left_id"), "left_name", F.col("rid").alias("target_name"),
        F.round(F.coalesce(F.col("score"), F.lit(0.0)) / 100.0, 6).alias("confidence"),
        F.when(F.col("score") >= K.LINK_HIGH, "exact_match").when(F.col("score").isNotNull(), "fuzzy_match")
        .alias("match_type"),
        F.round(F.greatest("best", "score") / 100.0, 6).alias("best_score"))


def _difflib(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(Tp.DoubleType())
def _difflib_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_difflib(x, y) for x, y in zip(a, b)], dtype="float64")


def close_matches(left: DataFrame, right: DataFrame, lid: str, lname: str, rname: str,
                  n: int = K.CLOSE_MATCHES, cutoff: float = K.CLOSE_CUTOFF) -> DataFrame:
    """Many-to-one suggestions: up to ``n`` targets whose case-sensitive similarity
    is ≥ ``cutoff`` (ties: the later name first); each reported with its case-insensitive confidence."""
    hits, _ = _score_blocks(_names(left, lname, F.col(lname)), _names(right, rname, F.col(rname), "target", "tkey"),
                            lambda a, b: _difflib(b, a), cutoff)
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("target").desc())
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (left.select(F.col(lid).alias("left_id"), F.col(lname).alias("left_name")).join(top, F.col("left_name") == F.col("name"))
            .select("left_id", "left_name", "rank", F.col("target").alias("target_name"),
                    F.round(_difflib_score(F.lower("left_name"), F.lower("target")), 6).alias("confidence")))


def best_target(left: DataFrame, right: DataFrame, lid: str, lname: str, rname: str,
                low: float = K.LOW_CONFIDENCE) -> DataFrame:
    """J16 variant: the most similar target of names without punctuation and case (ties: first in target
    order), the first target when nothing is similar; ``low_confidence`` below ``low``."""
    def plain(c: str) -> Column:
        return F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9]", ""))

    hits, _ = _score_blocks(_names(left, lname, plain(lname)), _names(right, rname, plain(rname), "target", "tkey"), _difflib, 1e-9)
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("target"))
    best = hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    first = right.agg(F.min(rname).alias("first"))  # one row
    out = (left.select(F.col(lid).alias("left_id"), F.col(lname).alias("left_name"))
           .join(best, F.col("left_name") == F.col("name"), "left").join(F.broadcast(first)))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return out.select("left_id", "left_name", F.coalesce("target", "first").alias("target_name"),
                      F.round(score, 6).alias("confidence"), (score < low).alias("low_confidence"))


def alternatives(left: DataFrame, right: DataFrame, lid: str, lname: str, rname: str, taken: DataFrame | None = None,
                 k: int = K.ALTERNATIVES, min_score: int = K.ALTERNATIVE_MIN) -> DataFrame:
    """For unmatched source names, the ``k`` best targets that aren't ``taken`` (one column of names) by
    token-sort score on raw names, keeping scores ≥ ``min_score``. Only pairs whose sorted words share enough
    letters for that score are compared."""
    @F.pandas_udf(Tp.StringType())
    def sorted_words(names: pd.Series) -> pd.Series:
        return names.map(lambda x: " ".join(sorted(_tokens(x))))

    free = right if taken is None else right.join(taken.toDF(rname).distinct(), rname, "left_anti")
    def staged(df: DataFrame) -> DataFrame:
        path = scratch_path(left.sparkSession, "names")
        df.write.parquet(path)
        return left.sparkSession.read.schema(df.schema).parquet(path)

    sources, targets = staged(_names(left, lname, sorted_words(lname))), staged(_names(free, rname, sorted_words(rname), "target", "tkey"))
    pairs = pairs_above(sources, targets, lambda *x: _indel_bound(*x) + 0.5, min_score)  # scores are rounded
    wordless = sources.filter("key = ''").join(targets.filter("tkey = ''"), F.col("key") == F.col("tkey")).select("name", "key", "target", "tkey")
    # wordless names are apart from the others, so that pairs are scored in the tasks that met them
    worded = pairs.filter("key <> '' or tkey <> ''")
    hits = _scored(worded.unionByName(wordless), ratio).filter(F.col("score") >= min_score)
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("target"))
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return (left.select(F.col(lid).alias("left_id"), F.col(lname).alias("left_name")).join(top, F.col("left_name") == F.col("name"))
            .select("left_id", "left_name", "rank", F.col("target").alias("target_name"), "score"))


def group_similarity(members: DataFrame, group_col: str, member_col: str, targets: DataFrame,
                     tgroup_col: str, tmember_col: str, top: int = K.GROUP_TOP) -> DataFrame:
    """Similarity of each source group to each target group: 0.7·mean best member score + 0.3·share of
    members whose best > 70, using the 0.5 ratio / 0.3 partial / 0.2 token-sort scorer; total = 0.6·that +
    0.4·group-name ratio; the ``top`` target groups per source group.

    Distinct members are scored once; the rest is max per (group, target group, member), then sums per pair of groups.
    """
    w1, w2, w3 = K.GROUP_MEMBER_WEIGHTS

    def score(a: str, b: str) -> float:
        return ratio(a, b) * w1 + partial_ratio(a, b) * w2 + token_sort_ratio(a, b) * w3

    own = members.select(F.col(group_col).cast("string").alias("g"), F.col(member_col).cast("string").alias("m")).distinct().dropna()
    other = targets.select(F.col(tgroup_col).cast("string").alias("tg"), F.col(tmember_col).cast("string").alias("tm")).distinct().dropna()
    hits, _ = _score_blocks(_names(own, "m", F.lower("m")), _names(other, "tm", F.lower("tm"), "target", "tkey"), score, 1e-9)
    best = (own.join(hits, F.col("m") == F.col("name")).join(other, F.col("target") == F.col("tm"))
            .groupBy("g", "tg", "m").agg(F.max("score").alias("best")))
    sums = best.groupBy("g", "tg").agg(F.sum("best").alias("s"), F.count_if(F.col("best") > K.GROUP_GOOD_MEMBER).alias("good"))
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    names, _ = _score_blocks(_names(own, "g", F.lower("g")), _names(other, "tg", F.lower("tg"), "target", "tkey"), ratio, 0)
    pairs = names.select(F.col("name").alias("g"), F.col("target").alias("tg"), F.col("score").alias("name_score")).join(sums, ["g", "tg"], "left").join(sizes, "g")
    member = (K.GROUP_MEAN_SHARE[0] * F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n")
              + K.GROUP_MEAN_SHARE[1] * F.coalesce(F.col("good"), F.lit(0)) / F.col("n") * 100)
    scored = pairs.withColumn("member_score", F.round(member, 6)).withColumn(
        "score", F.round(K.GROUP_TOTAL_WEIGHTS[0] * member + K.GROUP_TOTAL_WEIGHTS[1] * F.col("name_score"), 6))
    w = Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("tg"))
    return scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).select(
        F.col("g").alias("source_group"), F.col("tg").alias("target_group"), "score", "member_score")
