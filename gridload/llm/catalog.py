"""Registered queries of the training-data operators and their DuckDB oracles.

Each query applies one operator to its whole table and derives the columns it returns from the
operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm import ann, decontaminate, gram_join, line_dedup, minhash, mixing, negatives, page_text, secrets, sharding, toxicity, warc, whitening
from gridload.llm.common import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


# ---- 1 mixing ---------------------------------------------------------------------------------------

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
      3.0::DOUBLE * source_size AS top FROM s),
p AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER before, 0))::DOUBLE
             / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lam, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS pos
      FROM r WINDOW before AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(w * (SELECT lam FROM p WHERE lam * w <= top ORDER BY pos LIMIT 1), top) AS target FROM p),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM o
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# ---- 2 html extraction ------------------------------------------------------------------------------

#: What the generator's pages hold: one article element, no attributes in it, these references.
PAGE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
             '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t
      FROM a),
x AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM e)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM x
"""


@query("op2_page_text", PAGE_SQL)
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# ---- 3 nearest neighbours ---------------------------------------------------------------------------

@query("op3_nearest")
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# ---- 4 secret scan ----------------------------------------------------------------------------------

def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["stop"].cast("string"))), ",")


def _secret_sql() -> str:
    def spans(rule, order):
        keep = (f"length(regexp_extract(m[i], '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})) >= {rule.least}")
        pat = rule.pattern.replace("'", "''")
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, i, m[i] AS hit, {keep} AS ok,
          coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
        FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pat}') AS m, regexp_split_to_array(coalesce(text, ''), '{pat}') AS p
          FROM documents))"""
    parts = " UNION ALL ".join(spans(r, k) for k, r in enumerate(secrets.RULES))
    return f"""
WITH h AS ({parts}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT, ',' ORDER BY start, ord) AS spans
      FROM h WHERE ok GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op4_secret_scan", _secret_sql())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, findings = secrets.scan(docs, "text")
    found = secrets.findings_by_path(docs, "text", ["doc_id"], findings)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_span_text(F.col("spans")), 256).alias("base_sha256"),
                        _span_text(F.col("spans")).alias("spans"))


# ---- 5 sharding -------------------------------------------------------------------------------------

#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20

SHARD_SQL = f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k,
             coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
e AS (SELECT doc_id, k, n_bytes, unnest(range(0, 31)) AS depth FROM d),
b AS (SELECT doc_id, n_bytes, depth, k >> (60 - depth) AS prefix,
        sum(n_bytes) OVER (PARTITION BY depth, k >> (60 - depth)) AS shard_bytes FROM e),
f AS (SELECT doc_id, n_bytes, min(depth) AS depth, arg_min(prefix, depth) AS prefix,
        arg_min(shard_bytes, depth)::BIGINT AS shard_bytes FROM b WHERE shard_bytes <= {SHARD_BYTES} GROUP BY 1, 2)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, shard_bytes,
  CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard
FROM f
"""


@query("op5_shard", SHARD_SQL)
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), max_bytes=SHARD_BYTES)
    return dealt.select("row.doc_id", "n_bytes", "depth", "shard_bytes", "shard")


# ---- 6 WARC -----------------------------------------------------------------------------------------

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS head FROM p GROUP BY 1)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(p.h, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM p JOIN f ON p.h = f.h
"""


@query("op6_warc_index", WARC_SQL)
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- 7 near duplicates ------------------------------------------------------------------------------

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN c ON c.a = documents.doc_id
"""


@query("op7_near_duplicates", NEAR_SQL)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


# ---- 8 toxicity -------------------------------------------------------------------------------------

@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


# ---- 9 line dedup -----------------------------------------------------------------------------------

LINE_SQL = r"""
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT DISTINCT doc_id, source, h, regexp_replace(line, '\r$', '') AS line
      FROM (SELECT doc_id, source, md5(text) AS h, unnest(lines) AS line FROM l) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY 1),
bad AS (SELECT p.source, p.line FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        GROUP BY p.source, p.line, host_pages HAVING min(h) <> max(h) AND count(*) > 0.1 * host_pages),
bl AS (SELECT source, list(line) AS bad FROM bad GROUP BY 1),
k AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]')
        OR NOT list_contains(coalesce(bad, []), regexp_replace(x, '\r$', ''))) AS kept
      FROM l LEFT JOIN bl ON l.source IS NOT DISTINCT FROM bl.source)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM k
"""


@query("op9_line_dedup", LINE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("row.doc_id", "text", "n_lines", "n_dropped")


# ---- 10 benchmark decontamination -------------------------------------------------------------------

LEAK_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, z, array_to_string(w[i:i + z - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS z, unnest(range(1, greatest(0, len(w) - 10) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, z, i, array_to_string(w[i:i + z - 1], ' ') AS win
       FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM low, (SELECT DISTINCT z FROM iw) WHERE len(w) >= z)),
h AS (SELECT doc_id, z, i, item_id FROM dw JOIN iw USING (z, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS j FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit ON hit.doc_id = low.doc_id LEFT JOIN i ON i.doc_id = low.doc_id
"""


@query("op10_decontaminate", LEAK_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


# ---- 11 embedding whitening -------------------------------------------------------------------------

@query("op11_whiten")
def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit, error = whitening.whiten(table(spark, sf_dir, "embeddings"))
    share = F.array(*[F.lit(float(v)) for v in fit.explained]).cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), F.lit(fit.n).cast("long").alias("n"),
                       F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


# ---- 12 n-gram Jaccard join -------------------------------------------------------------------------

#: The exhaustive join of operator 7's SQL, with five-word shingles.
JOIN_SQL = NEAR_SQL.replace("least(4, len(w))", "least(5, len(w))").replace("len(w) - 3", "len(w) - 4").replace(
    ", documents.doc_id = component_id AS kept", "")


@query("op12_gram_join", JOIN_SQL)
def op12_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gram_join.gram_join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


# ---- 13 hard negatives ------------------------------------------------------------------------------

HARD_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


@query("op13_hard_negatives", HARD_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        "positive_score", "negative_score")
