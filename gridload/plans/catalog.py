"""Registered queries: one per operator of the inventory, each over whole tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where SQL can express the
result, ``ORACLE[name]`` holds the same computation as DuckDB SQL over the
driver's views. Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import incremental as I
from ..sources import tables as S
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def T(spark, d, name):
    return S.table(spark, d, name)


# =============================================================================
# Incremental load: J1 J2 J3 S6 A13 A14
# =============================================================================

@query("j1_filter_new_orders", sql=f"""
SELECT o.* FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM {X.TARGET_ORDERS_SQL} t WHERE t.o_orderkey IS NOT DISTINCT FROM o.o_orderkey)
""")
def j1_filter_new_orders(spark, d):
    return I.filter_new(X.orders(spark, d), X.target_orders(spark, d), ["o_orderkey"])


@query("j1_filter_new_nullsafe", sql=f"""
SELECT o.* FROM {X.NULLKEY_ORDERS_SQL} o
WHERE NOT EXISTS (SELECT 1 FROM {X.NULLKEY_TARGET_SQL} t
                  WHERE t.o_custkey_n IS NOT DISTINCT FROM o.o_custkey_n
                    AND t.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus)
""")
def j1_filter_new_nullsafe(spark, d):
    return I.filter_new(X.nullkey_orders(spark, d), X.nullkey_target(spark, d),
                        ["o_custkey_n", "o_orderstatus"])


@query("j1_filter_new_hot_null_key", sql=f"""
SELECT o.* FROM {X.NULLKEY_ORDERS_SQL} o
WHERE NOT EXISTS (SELECT 1 FROM {X.NULLKEY_TARGET_SQL} t WHERE t.o_custkey_n IS NOT DISTINCT FROM o.o_custkey_n)
""")
def j1_filter_new_hot_null_key(spark, d):
    # one key with a hot null group (a fifth of the orders): salted null keys, scalar null test
    return I.filter_new(X.nullkey_orders(spark, d), X.nullkey_target(spark, d), ["o_custkey_n"])


@query("j2_exists_flag", sql=f"""
SELECT o.*, EXISTS (SELECT 1 FROM {X.NULLKEY_TARGET_SQL} t
                    WHERE t.o_custkey_n IS NOT DISTINCT FROM o.o_custkey_n
                      AND t.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority) AS exists_in_db
FROM {X.NULLKEY_ORDERS_SQL} o
""")
def j2_exists_flag(spark, d):
    return I.flag_existing(X.nullkey_orders(spark, d), X.nullkey_target(spark, d),
                           ["o_custkey_n", "o_orderpriority"])


@query("j3_semi_touched", sql="""
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM orders o
WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def j3_semi_touched(spark, d):
    touched = T(spark, d, "lineitem").filter(F.col("l_returnflag") == "R") \
        .select(F.col("l_orderkey").alias("o_orderkey"))
    return I.existing(X.orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus"),
                      touched, ["o_orderkey"])


@query("s6_insert_if_absent", sql=f"""
SELECT * FROM {X.TARGET_ORDERS_SQL} t
UNION ALL
SELECT o.* FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM {X.TARGET_ORDERS_SQL} t WHERE t.o_orderkey = o.o_orderkey)
""")
def s6_insert_if_absent(spark, d):
    return I.insert_if_absent(X.target_orders(spark, d), X.orders(spark, d), ["o_orderkey"])


@query("a13_load_stats", sql=f"""
WITH f AS (
  SELECT EXISTS (SELECT 1 FROM {X.NULLKEY_TARGET_SQL} t
                 WHERE t.o_custkey_n IS NOT DISTINCT FROM o.o_custkey_n
                   AND t.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus) AS e
  FROM {X.NULLKEY_ORDERS_SQL} o)
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE NOT e) AS new_records,
       count(*) FILTER (WHERE e) AS existing_records,
       round(count(*) FILTER (WHERE NOT e) / count(*), 6) AS filter_rate,
       round(count(*) FILTER (WHERE e) * 100.0 / count(*), 4) AS duplicate_pct
FROM f
""")
def a13_load_stats(spark, d):
    return I.load_stats(X.nullkey_orders(spark, d), X.nullkey_target(spark, d),
                        ["o_custkey_n", "o_orderstatus"])


@query("a14_preview_stats", sql=f"""
WITH s AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100),
f AS (SELECT EXISTS (SELECT 1 FROM {X.TARGET_ORDERS_SQL} t WHERE t.o_orderkey = s.o_orderkey) AS e FROM s)
SELECT (SELECT count(*) FROM orders) AS total_records,
       count(*) AS sample_size,
       count(*) FILTER (WHERE e) AS sample_duplicates,
       round(count(*) FILTER (WHERE e) / count(*), 6) AS duplicate_rate,
       CAST(floor((SELECT count(*) FROM orders) * (count(*) FILTER (WHERE e) / count(*))) AS BIGINT)
         AS estimated_duplicates
FROM f
""")
def a14_preview_stats(spark, d):
    return I.preview_stats(X.orders(spark, d), X.target_orders(spark, d), ["o_orderkey"],
                           [F.col("o_totalprice").desc(), F.col("o_orderkey")], n=100)


# =============================================================================
# In-batch duplicates: W1 A9 A10 W2
# =============================================================================

_LINE_KEYS = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_ORDER_SQL = ", ".join(_LINE_ORDER)
_LINE_ORDER_DESC_SQL = ", ".join(f"{c} DESC" for c in _LINE_ORDER)


@query("w1_dedup_first", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER_SQL}) AS rn
  FROM lineitem) WHERE rn = 1
""")
def w1_dedup_first(spark, d):
    return D.dedup(T(spark, d, "lineitem"), _LINE_KEYS, _LINE_ORDER, keep="first")


@query("w1_dedup_last", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER_DESC_SQL}) AS rn
  FROM lineitem) WHERE rn = 1
""")
def w1_dedup_last(spark, d):
    return D.dedup(T(spark, d, "lineitem"), _LINE_KEYS, _LINE_ORDER, keep="last")


@query("w1_dedup_none", sql="""
SELECT * EXCLUDE (n) FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1
""")
def w1_dedup_none(spark, d):
    return D.dedup(T(spark, d, "lineitem"), _LINE_KEYS, _LINE_ORDER, keep=False)


@query("w1_dedup_nullkey_first", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey_n ORDER BY o_orderdate, o_orderkey) AS rn
  FROM {X.NULLKEY_ORDERS_SQL}) WHERE rn = 1
""")
def w1_dedup_nullkey_first(spark, d):
    return D.dedup(X.nullkey_orders(spark, d), ["o_custkey_n"], ["o_orderdate", "o_orderkey"], "first")


@query("a9_full_duplicate_rows", sql="""
WITH l AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS duplicate_rows
FROM l
""")
def a9_full_duplicate_rows(spark, d):
    lines = T(spark, d, "lineitem")  # every first line arrives twice
    return D.full_duplicate_count(lines.unionByName(lines.filter(F.col("l_linenumber") == 1)))


@query("a10_duplicate_summary", sql="""
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_count,
       CAST(coalesce(sum(n) FILTER (WHERE n = 1), 0) AS BIGINT) AS unique_count,
       count(*) FILTER (WHERE n > 1 AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) AS total_groups,
       coalesce(sum(n) FILTER (WHERE n > 1), 0) > 0 AS has_internal_duplicates
FROM k
""")
def a10_duplicate_summary(spark, d):
    return D.duplicate_summary(T(spark, d, "lineitem"), _LINE_KEYS)


@query("a10_duplicate_summary_nullkey", sql=f"""
WITH k AS (SELECT o_custkey_n, count(*) AS n FROM {X.NULLKEY_ORDERS_SQL} GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_count,
       CAST(coalesce(sum(n) FILTER (WHERE n = 1), 0) AS BIGINT) AS unique_count,
       count(*) FILTER (WHERE n > 1 AND o_custkey_n IS NOT NULL) AS total_groups,
       coalesce(sum(n) FILTER (WHERE n > 1), 0) > 0 AS has_internal_duplicates
FROM k
""")
def a10_duplicate_summary_nullkey(spark, d):
    return D.duplicate_summary(X.nullkey_orders(spark, d), ["o_custkey_n"])


@query("a10_duplicate_groups", sql=f"""
SELECT o_custkey_n, count(*) AS dup_count, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row
FROM {X.NULLKEY_ORDERS_SQL} WHERE o_custkey_n IS NOT NULL GROUP BY o_custkey_n HAVING count(*) > 1
""")
def a10_duplicate_groups(spark, d):
    # o_orderkey equals the row position in the export, so it serves as the row id
    return D.duplicate_groups(X.nullkey_orders(spark, d), ["o_custkey_n"], row_id="o_orderkey")


@query("w2_repeated_texts", sql="""
SELECT d.doc_id, d.lang, d.source, c.dup_count
FROM documents d JOIN (SELECT text, count(*) AS dup_count FROM documents GROUP BY text HAVING count(*) > 1) c
  ON d.text IS NOT DISTINCT FROM c.text
""")
def w2_repeated_texts(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return D.repeated_values(docs, "text").select("doc_id", "lang", "source", "dup_count")


# =============================================================================
# Scans, projections, filters: S1 S8 P17 P18
# =============================================================================

@query("s1_param_scan", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 250000.0
""")
def s1_param_scan(spark, d):
    return S.sql_query(spark, d, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                       "WHERE o_orderstatus = :status AND o_totalprice > :min_price",
                       args={"status": "F", "min_price": 250000.0}, tables=["orders"])


_COUNT_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("s8_table_counts", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _COUNT_TABLES))
def s8_table_counts(spark, d):
    out = None
    for t in _COUNT_TABLES:
        one = T(spark, d, t).agg(F.count(F.lit(1)).alias("row_count")) \
            .select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("p17_filter_const", sql="SELECT * FROM orders WHERE o_orderstatus = 'F'")
def p17_filter_const(spark, d):
    return X.orders(spark, d).filter(F.col("o_orderstatus") == "F")


@query("p18_projection", sql="SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def p18_projection(spark, d):
    return T(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


# =============================================================================
# Typing: P2-P11, A7, A8, P15
# =============================================================================
from ..functions import columns as C  # noqa: E402
from ..functions import constants as K  # noqa: E402
from ..operators import profile as PR  # noqa: E402
from ..operators import typing_ops as TY  # noqa: E402


def _sql_list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("p2_drop_null_columns", sql="SELECT * FROM orders")
def p2_drop_null_columns(spark, d):
    o = X.orders(spark, d).withColumn("o_comment", F.lit(None).cast("string"))
    return TY.drop_all_null_columns(o)


@query("p3_drop_null_rows", sql="SELECT * FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def p3_drop_null_rows(spark, d):
    c = T(spark, d, "customer")
    blank = c.columns
    holed = c.select(*[F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col(x)).alias(x) for x in blank])
    return TY.drop_all_null_rows(holed)


_DIRTY_HEADERS = ["Customer Key!", "  Company   Name ", "Nation#Key", "Acct Bal ($)", "Segment?"]
_HEADER_MAPPING = {
    "Customer Key!": {"target": "customer_id", "confidence": 0.95},
    "Company Name": {"target": "company_name", "confidence": 0.9},
    "Acct Bal ($)": {"target": "balance", "confidence": 0.4},
    "Segment?": {"target": "segment", "confidence": 0.75},
}


@query("p4_rename_mapping", sql="""
SELECT c_custkey AS customer_id, c_name AS company_name, c_nationkey AS "NationKey",
       c_acctbal AS "Acct Bal ", c_mktsegment AS segment FROM customer
""")
def p4_rename_mapping(spark, d):
    sheet = T(spark, d, "customer").toDF(*_DIRTY_HEADERS)
    return TY.apply_mapping(sheet, _HEADER_MAPPING)


_INT_SQL = ("CASE WHEN TRY_CAST(trim({c}) AS DOUBLE) = floor(TRY_CAST(trim({c}) AS DOUBLE)) "
            "THEN TRY_CAST(TRY_CAST(trim({c}) AS DOUBLE) AS BIGINT) END")


@query("p5_to_integer_row", sql=f"""
SELECT order_key, {_INT_SQL.format(c='order_key')} AS order_key_int,
       {_INT_SQL.format(c='amount_dot')} AS amount_int FROM {X.ORDERS_TEXT_SQL}
""")
def p5_to_integer_row(spark, d):
    t = X.orders_text(spark, d)
    return t.select("order_key", C.to_integer("order_key").alias("order_key_int"),
                    C.to_integer("amount_dot").alias("amount_int"))


@query("p5_to_integer_column", sql=f"""
SELECT {_INT_SQL.format(c='order_key')} AS order_key, amount_dot FROM {X.ORDERS_TEXT_SQL}
""")
def p5_to_integer_column(spark, d):
    t = X.orders_text(spark, d).select("order_key", "amount_dot")
    return TY.cast_columns(t, {"order_key": "int", "amount_dot": "int"}, int_mode="column")


@query("p6_to_float", sql=f"""
SELECT order_key, TRY_CAST(trim(amount_plain) AS DOUBLE) AS amount_plain_f,
       TRY_CAST(trim(amount_dot) AS DOUBLE) AS amount_dot_f FROM {X.ORDERS_TEXT_SQL}
""")
def p6_to_float(spark, d):
    t = X.orders_text(spark, d)
    return t.select("order_key", C.to_double("amount_plain").alias("amount_plain_f"),
                    C.to_double("amount_dot").alias("amount_dot_f"))


def _sql_ts(c):
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"]
    return "coalesce(" + ", ".join(f"try_strptime(trim({c}), '{f}')" for f in fmts) + ")"


@query("p7_to_datetime", sql=f"""
SELECT order_key, {_sql_ts('order_date')} AS order_ts, {_sql_ts('order_date_iso')} AS order_ts_iso,
       {_sql_ts('priority')} AS priority_ts FROM {X.ORDERS_TEXT_SQL}
""")
def p7_to_datetime(spark, d):
    t = X.orders_text(spark, d)
    return t.select("order_key", C.to_timestamp_multi("order_date").alias("order_ts"),
                    C.to_timestamp_multi("order_date_iso").alias("order_ts_iso"),
                    C.to_timestamp_multi("priority").alias("priority_ts"))


@query("p8_to_boolean", sql=f"""
SELECT order_key, status_word,
  CASE WHEN lower(trim(status_word)) IN ({_sql_list(K.BOOL_TRUE_WORDS)}) THEN true
       WHEN lower(trim(status_word)) IN ({_sql_list(K.BOOL_FALSE_WORDS)}) THEN false END AS status_flag
FROM {X.ORDERS_TEXT_SQL}
""")
def p8_to_boolean(spark, d):
    t = X.orders_text(spark, d)
    return t.select("order_key", "status_word", C.to_boolean("status_word").alias("status_flag"))


_TOKEN_SQL = """CASE priority WHEN '1-URGENT' THEN ' nan ' WHEN '2-HIGH' THEN 'N/A' WHEN '3-MEDIUM' THEN ' null'
  WHEN '4-NOT SPECIFIED' THEN '' ELSE ' ' || priority || ' ' END"""


def _with_tokens(t):
    p = F.col("priority")
    tok = (F.when(p == "1-URGENT", " nan ").when(p == "2-HIGH", "N/A").when(p == "3-MEDIUM", " null")
           .when(p == "4-NOT SPECIFIED", "").otherwise(F.concat(F.lit(" "), p, F.lit(" "))))
    return t.select("order_key", tok.alias("raw"))


@query("p9_text_normalise", sql=f"""
SELECT order_key, CASE WHEN trim(raw) = 'nan' THEN NULL ELSE trim(raw) END AS clean
FROM (SELECT order_key, {_TOKEN_SQL} AS raw FROM {X.ORDERS_TEXT_SQL})
""")
def p9_text_normalise(spark, d):
    return _with_tokens(X.orders_text(spark, d)).select("order_key", C.normalize_text("raw").alias("clean"))


@query("p10_null_tokens", sql=f"""
SELECT order_key, CASE WHEN lower(trim(raw)) IN ({_sql_list(K.NULL_TOKENS)}) THEN NULL ELSE trim(raw) END AS clean
FROM (SELECT order_key, {_TOKEN_SQL} AS raw FROM {X.ORDERS_TEXT_SQL})
""")
def p10_null_tokens(spark, d):
    return _with_tokens(X.orders_text(spark, d)).select(
        "order_key", C.normalize_text("raw", null_tokens=True).alias("clean"))


@query("p11_locale_money", sql=f"""
SELECT order_key, amount_money,
  TRY_CAST(replace(replace(regexp_replace(amount_money, '[\\$\\s]', '', 'g'), '.', ''), ',', '.') AS DECIMAL(19,4))
    AS amount
FROM {X.ORDERS_TEXT_SQL}
""")
def p11_locale_money(spark, d):
    t = X.orders_text(spark, d)
    return t.select("order_key", "amount_money", C.parse_locale_number("amount_money").alias("amount"))


_TEXT_COLS = ["order_key", "cust_key", "amount_plain", "amount_money", "amount_dot", "order_date",
              "order_date_iso", "status_word", "priority"]


def _sql_vote_class(v):
    nc = f"replace({v}, ',', '')"
    return (f"CASE WHEN lower({v}) IN ({_sql_list(K.BOOL_TRUE_WORDS + K.BOOL_FALSE_WORDS)}) THEN 'BOOLEAN' "
            f"WHEN regexp_matches({v}, '{K.VOTE_DATE_PATTERNS[0]}') OR regexp_matches({v}, '{K.VOTE_DATE_PATTERNS[1]}') "
            f"THEN 'DATE' WHEN regexp_matches({v}, '{K.VOTE_DATETIME_PATTERN}') THEN 'DATETIME' "
            f"WHEN regexp_matches({nc}, '{K.VOTE_INTEGER_PATTERN}') THEN 'INTEGER' "
            f"WHEN regexp_matches({nc}, '{K.VOTE_DECIMAL_PATTERNS[0]}') OR regexp_matches({v}, '{K.VOTE_DECIMAL_PATTERNS[1]}') "
            f"THEN 'DECIMAL' ELSE 'STRING' END")


def _sql_type_vote(src, cols):
    types = TY.VOTE_TYPES
    counts = ", ".join(f"count(*) FILTER (WHERE cls = '{t}') AS n_{t.lower()}" for t in types)
    best = "greatest(" + ", ".join(f"n_{t.lower()}" for t in types) + ")"
    pick = "CASE " + " ".join(f"WHEN n_{t.lower()} = {best} THEN '{t}'" for t in types) + " END"
    return f"""
WITH l AS (UNPIVOT (SELECT {', '.join(cols)} FROM {src}) ON {', '.join(cols)} INTO NAME column_name VALUE value),
c AS (SELECT column_name, {_sql_vote_class('trim(value)')} AS cls FROM l WHERE value IS NOT NULL),
g AS (SELECT column_name, count(cls) AS n_values, {counts} FROM c GROUP BY column_name)
SELECT *, CASE WHEN n_values > 0 AND {best} >= {K.VOTE_THRESHOLD} * n_values THEN {pick} ELSE 'STRING' END
  AS detected_type FROM g"""


@query("a7_type_vote", sql=_sql_type_vote(X.ORDERS_TEXT_SQL, _TEXT_COLS))
def a7_type_vote(spark, d):
    return TY.type_vote(X.orders_text(spark, d), _TEXT_COLS)


def _sql_kind(src, cols, order_expr):
    v = "lower(trim(value))"
    kind = (f"CASE WHEN regexp_matches({v}, '{K.EMAIL_PATTERN}') THEN 'email' "
            f"WHEN regexp_matches({v}, '{K.PHONE_PATTERN}') THEN 'phone' "
            f"WHEN regexp_matches({v}, '{K.NUMERIC_PATTERN}') THEN 'numeric' "
            f"WHEN regexp_matches({v}, '{K.DATE_PATTERN}') THEN 'date' "
            f"WHEN {v} IN ({_sql_list(K.BOOL_TRUE_WORDS + K.BOOL_FALSE_WORDS)}) THEN 'boolean' END")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in TY.KIND_ORDER)
    pick = "CASE " + " ".join(f"WHEN n_{k} >= {K.KIND_THRESHOLD} * n_sampled THEN '{k}'"
                              for k in TY.KIND_ORDER) + " ELSE 'string' END"
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return f"""
WITH b AS (SELECT {order_expr} AS _o, {casts} FROM {src}),
l AS (UNPIVOT b ON {', '.join(cols)} INTO NAME column_name VALUE value),
s AS (SELECT * FROM l WHERE value IS NOT NULL),
g AS (SELECT column_name, count(*) AS n_sampled, {counts} FROM (SELECT column_name, {kind} AS kind FROM s) GROUP BY column_name)
SELECT column_name, n_sampled, {', '.join('n_' + k for k in TY.KIND_ORDER)}, {pick} AS inferred_kind FROM g"""


@query("a8_kind_orders_text", sql=_sql_kind(X.ORDERS_TEXT_SQL, _TEXT_COLS, "CAST(order_key AS BIGINT)"))
def a8_kind_orders_text(spark, d):
    t = X.orders_text(spark, d).withColumn("_k", F.col("order_key").cast("bigint"))
    return TY.semantic_kind(t, ["_k"], _TEXT_COLS)


_SHEET_COLS = ["customer_id", "company_name", "customer_code", "total_amount", "email", "segment"]


@query("a8_kind_customer_sheet", sql=_sql_kind(X.CUSTOMER_SHEET_SQL, _SHEET_COLS, "customer_id"))
def a8_kind_customer_sheet(spark, d):
    s = X.customer_sheet(spark, d).withColumn("_k", F.col("customer_id"))
    return TY.semantic_kind(s, ["_k"], _SHEET_COLS)


@query("p15_token_patterns", sql=f"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '\\S+')) AS tok FROM documents)
SELECT lang, count(*) AS n_tokens,
  count(*) FILTER (WHERE regexp_matches(tok, '{K.EMAIL_PATTERN}')) AS n_email,
  count(*) FILTER (WHERE regexp_matches(tok, '{K.PHONE_PATTERN}')) AS n_phone,
  count(*) FILTER (WHERE regexp_matches(tok, '{K.NUMERIC_PATTERN}')) AS n_numeric,
  count(*) FILTER (WHERE regexp_matches(tok, '{K.DATE_PATTERN}')) AS n_date
FROM t GROUP BY lang
""")
def p15_token_patterns(spark, d):
    docs = T(spark, d, "documents").select("lang", F.regexp_extract_all("text", F.lit(r"\S+"), 0).alias("toks"))
    # cheap guards first (And short-circuits in generated code): an email holds '@'; phone,
    # numeric and date tokens start with a sign, a dot or a digit
    def guard(kind, tok):
        return tok.contains("@") if kind == "email" else F.substring(tok, 1, 1).isin(*list("+-.0123456789"))

    # counted within each row, so no token becomes a row
    def hits(kind):
        return F.size(F.filter("toks", lambda tok: guard(kind, tok) & C.matches(tok, kind))).alias(f"n_{kind}")

    per_row = docs.select("lang", F.size("toks").alias("n_tokens"), *[hits(k) for k in ["email", "phone", "numeric", "date"]])
    return per_row.groupBy("lang").agg(*[F.sum(c).cast("bigint").alias(c) for c in per_row.columns[1:]]).filter("n_tokens > 0")


# =============================================================================
# Profiles: A2-A6
# =============================================================================

def _sql_profile(src, cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, "
                     f"count(DISTINCT {c}) AS distinct_count FROM {src}")
    body = " UNION ALL ".join(parts)
    return (f"SELECT *, round((null_count * 100.0) / n_rows, 4) AS null_pct, "
            f"round((null_count * 100.0) / n_rows, 4) > 50 AS null_warning FROM ({body})")


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("a2_profile_orders", sql=_sql_profile("orders", _ORDERS_COLS))
def a2_profile_orders(spark, d):
    return PR.column_profile(X.orders(spark, d), _ORDERS_COLS)


_NK_COLS = ["o_orderkey", "o_custkey_n", "o_orderstatus", "o_totalprice"]


@query("a2_profile_nullkey", sql=_sql_profile(X.NULLKEY_ORDERS_SQL, _NK_COLS))
def a2_profile_nullkey(spark, d):
    return PR.column_profile(X.nullkey_orders(spark, d), _NK_COLS)


def _sql_numeric(src, col):
    return f"""
WITH x AS (SELECT TRY_CAST({col} AS DOUBLE) AS x FROM {src}),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)
SELECT '{col}' AS column_name, count(x) AS n_values, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value,
  round(avg(x), 6) AS mean_value, round(stddev_samp(x), 6) AS std_value,
  round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(iqr), 6) AS iqr,
  round(any_value(lower_bound), 6) AS lower_bound, round(any_value(upper_bound), 6) AS upper_bound,
  count(*) FILTER (WHERE x < lower_bound OR x > upper_bound) AS outliers
FROM x, b"""


@query("a3_numeric_profile_orders", sql=_sql_numeric("orders", "o_totalprice"))
def a3_numeric_profile_orders(spark, d):
    return PR.numeric_profile(X.orders(spark, d), "o_totalprice")


@query("a3_numeric_profile_lineitem", sql=_sql_numeric("lineitem", "l_extendedprice"))
def a3_numeric_profile_lineitem(spark, d):
    return PR.numeric_profile(T(spark, d, "lineitem"), "l_extendedprice")


def _sql_value_checks(src, cols):
    email = f"regexp_matches(trim(value), '{K.EMAIL_PATTERN}')"
    phone = f"regexp_matches(regexp_replace(value, '[^\\d+]', '', 'g'), '{K.PHONE_PATTERN}')"
    date = f"{_sql_ts('value')} IS NOT NULL"
    return f"""
WITH l AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)} FROM {src})
           ON {', '.join(cols)} INTO NAME column_name VALUE value)
SELECT column_name, count(*) AS n_values,
  count(*) FILTER (WHERE {email}) AS valid_emails, count(*) FILTER (WHERE NOT {email}) AS invalid_emails,
  count(*) FILTER (WHERE {phone}) AS valid_phones, count(*) FILTER (WHERE NOT {phone}) AS invalid_phones,
  count(*) FILTER (WHERE {date}) AS valid_dates, count(*) FILTER (WHERE NOT ({date})) AS invalid_dates,
  count(*) FILTER (WHERE NOT {email}) > 0.1 * count(*) AS email_warning
FROM l WHERE value IS NOT NULL GROUP BY column_name"""


_CHECK_COLS = ["email", "customer_code", "company_name"]


@query("a4_a6_value_checks_customer", sql=_sql_value_checks(X.CUSTOMER_SHEET_SQL, _CHECK_COLS))
def a4_a6_value_checks_customer(spark, d):
    return PR.value_checks(X.customer_sheet(spark, d), _CHECK_COLS)


_CHECK_TEXT_COLS = ["cust_key", "order_date", "order_date_iso", "amount_dot"]


@query("a4_a6_value_checks_orders_text", sql=_sql_value_checks(X.ORDERS_TEXT_SQL, _CHECK_TEXT_COLS))
def a4_a6_value_checks_orders_text(spark, d):
    return PR.value_checks(X.orders_text(spark, d), _CHECK_TEXT_COLS)


# =============================================================================
# Validation: V1-V13, W3, W6, A11
# =============================================================================
from ..operators import rules as R  # noqa: E402

_SHEET_SPECS = [
    R.ColumnSpec("customer_id", "customer_id", "INTEGER", nullable=False),
    R.ColumnSpec("company_name", "company_name", "STRING", max_length=40, nullable=False),
    R.ColumnSpec("customer_code", "customer_code", "STRING", max_length=12),
    R.ColumnSpec("total_amount", "total_amount", "DECIMAL"),
    R.ColumnSpec("email", "email", "STRING", max_length=100),
    R.ColumnSpec("phone", "phone", "STRING"),
]
_SHEET_CONSTRAINTS = {"not_null_columns": ["email"], "unique_columns": ["customer_id"]}


def _sheet_issues(spark, d):
    sheet = X.customer_sheet(spark, d)
    return R.validate(sheet, _SHEET_SPECS, F.col("customer_id") + 2, _SHEET_CONSTRAINTS, as_of=X.AS_OF)


def _issue_sql(row, col, value, rule, message, sev, fix, src, where):
    fix_sql = "NULL" if fix is None else "'" + fix.replace("'", "''") + "'"
    return (f"SELECT CAST({row} AS BIGINT) AS row_number, '{col}' AS column_name, CAST({value} AS VARCHAR) AS value, "
            f"'{rule}' AS rule_name, {message} AS message, '{sev}' AS severity, CAST({fix_sql} AS VARCHAR) "
            f"AS suggested_fix FROM {src} WHERE {where}")


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_SHEET_ISSUES_SQL = " UNION ALL ".join([
    _issue_sql("customer_id + 2", "customer_code", "customer_code", "string_length",
               _q("Length exceeds the maximum allowed (12 characters)"), "ERROR", None,
               X.CUSTOMER_SHEET_SQL, "length(customer_code) > 12"),
    _issue_sql("customer_id + 2", "total_amount", "total_amount", "positive_number",
               _q("Value should be positive"), "WARNING", None, X.CUSTOMER_SHEET_SQL,
               "TRY_CAST(total_amount AS DOUBLE) < 0"),
    _issue_sql("customer_id + 2", "email", "email", "email_format", _q("Invalid email format"), "WARNING",
               None, X.CUSTOMER_SHEET_SQL, f"NOT regexp_matches(email, '{K.EMAIL_PATTERN}')"),
    _issue_sql("customer_id + 2", "customer_code", "customer_code", "potential_duplicate",
               _q("Possible duplicate value in column 'customer_code'"), "WARNING",
               "Check whether duplicates are intended", X.CUSTOMER_SHEET_SQL,
               f"customer_code IN (SELECT customer_code FROM {X.CUSTOMER_SHEET_SQL} GROUP BY 1 HAVING count(*) > 1)"),
    "SELECT 0, 'phone', '', 'missing_column', 'Expected column ''phone'' not found', 'ERROR', "
    "'Check the sheet''s column names'",
    "SELECT 0, 'segment', '', 'extra_column', 'Unexpected column ''segment'' found', 'INFO', "
    "'Consider adding it to the mapping'",
])


@query("v_issues_customer_sheet", sql=_SHEET_ISSUES_SQL)
def v_issues_customer_sheet(spark, d):
    return _sheet_issues(spark, d)


@query("a11_verdict_customer_sheet", sql=f"""
WITH i AS ({_SHEET_ISSUES_SQL}), n AS (SELECT count(*) AS processed_rows FROM {X.CUSTOMER_SHEET_SQL}),
s AS (SELECT count(*) FILTER (WHERE severity = 'ERROR') AS error_count,
             count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
             count(*) FILTER (WHERE severity = 'INFO') AS info_count,
             count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
             count(DISTINCT CASE WHEN severity = 'ERROR' AND row_number > 0 THEN row_number END) AS rows_with_errors
      FROM i)
SELECT processed_rows, error_count, warning_count, info_count, critical_count,
  round(error_count / processed_rows, 6) AS error_rate, error_count / processed_rows <= {K.MAX_ERROR_RATE} AS is_valid,
  processed_rows - error_count AS valid_rows, processed_rows - rows_with_errors AS rows_without_errors,
  error_count / processed_rows > {K.MAX_ERROR_RATE} AS high_error_rate_warning
FROM n, s
""")
def a11_verdict_customer_sheet(spark, d):
    return R.verdict(_sheet_issues(spark, d), X.customer_sheet(spark, d))


@query("w6_top_issues_customer_sheet", sql=f"""
SELECT *, row_number() OVER (PARTITION BY severity ORDER BY row_number, column_name, rule_name, message, value)
  AS issue_rank
FROM ({_SHEET_ISSUES_SQL}) i
QUALIFY issue_rank <= CASE severity WHEN 'ERROR' THEN 10 WHEN 'WARNING' THEN 5 ELSE 10 END
""")
def w6_top_issues_customer_sheet(spark, d):
    return R.top_issues(_sheet_issues(spark, d))


_ORDER_SPECS = [
    R.ColumnSpec("o_orderkey", "order_id", "INTEGER", nullable=False),
    R.ColumnSpec("o_custkey_n", "customer_id", "INTEGER", nullable=False),
    R.ColumnSpec("o_totalprice", "total", "DECIMAL"),
    R.ColumnSpec("o_orderdate", "order_date", "DATETIME"),
    R.ColumnSpec("o_orderstatus", "status", "BOOLEAN"),
    R.ColumnSpec("o_orderpriority", "priority", "STRING", max_length=8),
]
_ORDER_CONSTRAINTS = {"not_null_columns": ["customer_id"], "unique_columns": ["customer_id"]}
_NK = X.NULLKEY_ORDERS_SQL


@query("v_issues_nullkey_orders", sql=" UNION ALL ".join([
    _issue_sql("o_orderkey + 2", "o_custkey_n", "o_custkey_n", "required_value",
               _q("Required field cannot be empty"), "ERROR", None, _NK, "o_custkey_n IS NULL"),
    _issue_sql("o_orderkey + 2", "o_custkey_n", "'NULL'", "not_null_constraint",
               _q("Column 'customer_id' cannot be null"), "ERROR", "Provide a valid value", _NK,
               "o_custkey_n IS NULL"),
    _issue_sql("o_orderkey + 2", "o_orderstatus", "o_orderstatus", "data_type_validation",
               _q("Not a valid boolean value"), "ERROR", "Convert to type BOOLEAN", _NK,
               f"lower(trim(o_orderstatus)) NOT IN ({_sql_list(K.BOOL_CHECK_WORDS)})"),
    _issue_sql("o_orderkey + 2", "o_orderpriority", "o_orderpriority", "string_length",
               _q("Length exceeds the maximum allowed (8 characters)"), "ERROR", None, _NK,
               "length(o_orderpriority) > 8"),
    _issue_sql("o.o_orderkey + 2", "o_custkey_n", "o.o_custkey_n", "unique_constraint",
               _q("Duplicate value in unique column 'customer_id'"), "ERROR", "Ensure unique values",
               f"{_NK} o JOIN (SELECT o_custkey_n AS k FROM {_NK} GROUP BY 1 HAVING count(*) > 1) g "
               "ON o.o_custkey_n IS NOT DISTINCT FROM g.k", "true"),
]))
def v_issues_nullkey_orders(spark, d):
    o = X.nullkey_orders(spark, d)
    return R.validate(o, _ORDER_SPECS, F.col("o_orderkey") + 2, _ORDER_CONSTRAINTS, as_of=X.AS_OF)


def _sql_special(c):
    return "CASE " + " ".join(f"WHEN contains({c}, {_q(ch)}) THEN {_q(ch)}" for ch in K.SPECIAL_CHARS) + " END"


_DOC_SPECS = [R.ColumnSpec("text", "body", "STRING", max_length=20000),
              R.ColumnSpec("lang", "lang", "STRING", max_length=2),
              R.ColumnSpec("source", "source", "STRING", max_length=4)]


@query("v_issues_documents", sql=" UNION ALL ".join([
    _issue_sql("doc_id + 2", c, c, "string_length", _q(f"Length exceeds the maximum allowed ({n} characters)"),
               "ERROR", None, "documents", f"length({c}) > {n}")
    for c, n in [("text", 20000), ("lang", 2), ("source", 4)]] + [
    _issue_sql("doc_id + 2", c, c, "special_characters",
               f"'Contains potentially problematic characters: ' || {_sql_special(c)}", "INFO", None,
               "documents", f"{_sql_special(c)} IS NOT NULL") for c in ["text", "lang", "source"]]))
def v_issues_documents(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return R.validate(docs, _DOC_SPECS, F.col("doc_id") + 2, structure=False)


@query("w3_possible_duplicates_lineitem", sql="""
SELECT l_linenumber AS value, count(*) AS n_rows FROM lineitem
WHERE l_linenumber IN (SELECT l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) > 1)
GROUP BY l_linenumber
""")
def w3_possible_duplicates_lineitem(spark, d):
    li = T(spark, d, "lineitem")
    specs = [R.ColumnSpec(c, c, "STRING") for c in li.columns]
    reg = R.RuleRegistry()  # only the duplicate scan: no business rules
    issues = R.validate(li, specs, F.lit(0), registry=reg, structure=False)
    dup = issues.filter(F.col("rule_name") == "potential_duplicate")
    return dup.groupBy(F.col("value").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


# =============================================================================
# Change capture and audit: C1-C7, J10, W4, W5
# =============================================================================
from ..operators import cdc as CD  # noqa: E402

_NEW_ORDERS_SQL = (f"(SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM {X.TARGET_ORDERS_SQL} t "
                   "WHERE t.o_orderkey = o.o_orderkey))")


def _new_orders(spark, d):
    return I.filter_new(X.orders(spark, d), X.target_orders(spark, d), ["o_orderkey"])


@query("c1_insert_details", sql=f"""
SELECT CAST(1 AS BIGINT) AS log_id, CAST(o_orderkey AS VARCHAR) AS record_id, 'o_orderstatus' AS column_name,
       CAST(NULL AS VARCHAR) AS old_value, o_orderstatus AS new_value, 'NVARCHAR' AS data_type FROM {_NEW_ORDERS_SQL}
UNION ALL
SELECT 1, CAST(o_orderkey AS VARCHAR), 'o_totalprice', NULL, CAST(o_totalprice AS VARCHAR), 'FLOAT' FROM {_NEW_ORDERS_SQL}
""")
def c1_insert_details(spark, d):
    return CD.insert_details(_new_orders(spark, d), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("c1_operation_log", sql=f"""
SELECT CAST(1 AS BIGINT) AS log_id, 'SYSTEM' AS username, 'INSERT' AS operation_type, 'orders' AS table_name,
       'Data' AS schema_name, count(*) AS record_count, 'SUCCESS' AS operation_status,
       TIMESTAMP '{X.AS_OF}' AS operation_timestamp, 'gridload' AS application_name
FROM {_NEW_ORDERS_SQL}
""")
def c1_operation_log(spark, d):
    return CD.operation_log(_new_orders(spark, d), [], "INSERT", "orders", X.AS_OF)


_CDC_COLS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
_CDC_TYPES = {"o_orderstatus": "NVARCHAR", "o_totalprice": "FLOAT", "o_orderpriority": "NVARCHAR"}


@query("c2_update_details", sql=" UNION ALL ".join(
    f"SELECT CAST(1 AS BIGINT) AS log_id, CAST(b.o_orderkey AS VARCHAR) AS record_id, '{c}' AS column_name, "
    f"CAST(b.{c} AS VARCHAR) AS old_value, CAST(a.{c} AS VARCHAR) AS new_value, '{_CDC_TYPES[c]}' AS data_type "
    f"FROM {X.ORDERS_BEFORE_SQL} b JOIN {X.ORDERS_AFTER_SQL} a ON b.o_orderkey = a.o_orderkey "
    f"WHERE b.{c} IS DISTINCT FROM a.{c}" for c in _CDC_COLS))
def c2_update_details(spark, d):
    return CD.diff(X.orders_before(spark, d), X.orders_after(spark, d), "o_orderkey", _CDC_COLS)


@query("c3_delete_details", sql=" UNION ALL ".join(
    f"SELECT CAST(1 AS BIGINT) AS log_id, CAST(b.o_orderkey AS VARCHAR) AS record_id, '{c}' AS column_name, "
    f"CAST(b.{c} AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value, '{_CDC_TYPES[c]}' AS data_type "
    f"FROM {X.ORDERS_BEFORE_SQL} b WHERE NOT EXISTS (SELECT 1 FROM {X.ORDERS_AFTER_SQL} a "
    f"WHERE a.o_orderkey = b.o_orderkey)" for c in _CDC_COLS))
def c3_delete_details(spark, d):
    before, after = X.orders_before(spark, d), X.orders_after(spark, d)
    deleted = before.join(after.select("o_orderkey"), "o_orderkey", "left_anti")
    return CD.delete_details(deleted, "o_orderkey", _CDC_COLS)


_CLASSIFY_SQL = f"""(SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE'
       WHEN {' OR '.join(f'b.{c} IS DISTINCT FROM a.{c}' for c in _CDC_COLS)} THEN 'UPDATE'
       ELSE 'UNCHANGED' END AS change_type
FROM {X.ORDERS_BEFORE_SQL} b FULL OUTER JOIN {X.ORDERS_AFTER_SQL} a ON b.o_orderkey = a.o_orderkey)"""


@query("c4_classify_changes", sql=f"SELECT * FROM {_CLASSIFY_SQL}")
def c4_classify_changes(spark, d):
    return CD.classify(X.orders_before(spark, d), X.orders_after(spark, d), "o_orderkey", _CDC_COLS)


@query("c5_operation_log", sql=f"""
SELECT CAST(row_number() OVER (ORDER BY change_type) AS BIGINT) AS log_id, change_type, 'SYSTEM' AS username,
       change_type AS operation_type, 'orders' AS table_name, 'Data' AS schema_name, count(*) AS record_count,
       'SUCCESS' AS operation_status, TIMESTAMP '{X.AS_OF}' AS operation_timestamp, 'gridload' AS application_name
FROM {_CLASSIFY_SQL} WHERE change_type <> 'UNCHANGED' GROUP BY change_type
""")
def c5_operation_log(spark, d):
    cls = c4_classify_changes(spark, d).filter(F.col("change_type") != "UNCHANGED")
    return CD.operation_log(cls, ["change_type"], F.col("change_type"), "orders", X.AS_OF)


@query("c6_validation_errors", sql=f"""
SELECT CAST(row_number() OVER (ORDER BY row_number NULLS FIRST, column_name NULLS FIRST, rule_name NULLS FIRST,
         message NULLS FIRST, value NULLS FIRST) AS BIGINT) AS error_id,
       CAST(1 AS BIGINT) AS log_id, CAST(row_number AS INTEGER) AS row_number, column_name, rule_name AS error_type,
       message AS error_description, value AS invalid_value, suggested_fix AS expected_format,
       TIMESTAMP '{X.AS_OF}' AS error_timestamp
FROM ({_SHEET_ISSUES_SQL}) i
""")
def c6_validation_errors(spark, d):
    return CD.validation_error_rows(_sheet_issues(spark, d), 1, X.AS_OF)


_YEAR_OP_SQL = ("CASE year WHEN 1995 THEN 'INSERT' WHEN 1996 THEN 'UPDATE' WHEN 1997 THEN 'DELETE' "
                "WHEN 1998 THEN 'SELECT' WHEN 1999 THEN 'BULK_INSERT' WHEN 2000 THEN 'MERGE' ELSE 'INSERT' END")
_YEAR_ST_SQL = ("CASE year WHEN 1996 THEN 'FAILED' WHEN 1998 THEN 'PARTIAL' WHEN 2000 THEN 'RUNNING' "
                "ELSE 'SUCCESS' END")


def _case(col, mapping, default):
    e = None
    for k, v in mapping.items():
        e = F.when(F.col(col) == k, v) if e is None else e.when(F.col(col) == k, v)
    return e.otherwise(default)


@query("c7_audit_summary", sql=f"""
WITH lg AS (SELECT CAST(row_number() OVER (ORDER BY year) AS BIGINT) AS log_id, year, 'SYSTEM' AS username,
              {_YEAR_OP_SQL} AS operation_type, 'orders' AS table_name, count AS record_count,
              {_YEAR_ST_SQL} AS operation_status, TIMESTAMP '{X.AS_OF}' AS operation_timestamp
            FROM (SELECT year(o_orderdate) AS year, count(*) AS count FROM orders GROUP BY 1)),
er AS (SELECT year(o_orderdate) - 1994 AS log_id FROM {X.NULLKEY_ORDERS_SQL} WHERE o_custkey_n IS NULL)
SELECT log_id, username, operation_type, table_name, record_count, operation_status, operation_timestamp,
  CASE operation_status WHEN 'SUCCESS' THEN 'Exitoso' WHEN 'FAILED' THEN 'Fallido' WHEN 'PARTIAL' THEN 'Parcial'
       ELSE operation_status END AS status_label,
  CASE operation_type WHEN 'INSERT' THEN 'Inserción' WHEN 'UPDATE' THEN 'Actualización'
       WHEN 'DELETE' THEN 'Eliminación' WHEN 'SELECT' THEN 'Consulta' WHEN 'BULK_INSERT' THEN 'Inserción Masiva'
       ELSE operation_type END AS operation_label,
  (SELECT count(*) FROM er WHERE er.log_id = lg.log_id) AS validation_errors
FROM lg
""")
def c7_audit_summary(spark, d):
    o = X.orders(spark, d).withColumn("year", F.year("o_orderdate"))
    ops = {1995: "INSERT", 1996: "UPDATE", 1997: "DELETE", 1998: "SELECT", 1999: "BULK_INSERT", 2000: "MERGE"}
    sts = {1996: "FAILED", 1998: "PARTIAL", 2000: "RUNNING"}
    log = CD.operation_log(o, ["year"], _case("year", ops, "INSERT"), "orders", X.AS_OF,
                           status=_case("year", sts, "SUCCESS"))
    issues = R.validate(X.nullkey_orders(spark, d), _ORDER_SPECS, F.col("o_orderkey") + 2, structure=False)
    req = issues.filter(F.col("rule_name") == "required_value")
    years = o.select(F.col("o_orderkey"), (F.col("year") - 1994).cast("bigint").alias("log_id"))
    errors = req.join(years, req["row_number"] - 2 == years["o_orderkey"]).select("log_id")
    return CD.audit_summary(log, errors)


@query("w5_surrogate_ids", sql=f"""
SELECT o_orderkey, (SELECT max(o_orderkey) FROM {X.TARGET_ORDERS_SQL})
       + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id
FROM {_NEW_ORDERS_SQL}
""")
def w5_surrogate_ids(spark, d):
    new = _new_orders(spark, d).select("o_orderkey", "o_orderdate")
    top = X.target_orders(spark, d).agg(F.max("o_orderkey").alias("m")).first()["m"] or 0  # one number
    ids = CD.assign_ids(new, ["o_orderdate", "o_orderkey"], int(top), "new_id")
    return ids.select("o_orderkey", "new_id")


@query("w4_row_positions", sql="SELECT o_orderkey, o_orderkey + 2 AS sheet_row FROM orders")
def w4_row_positions(spark, d):
    pos = CD.row_positions(X.orders(spark, d).select("o_orderkey"))
    return pos.select("o_orderkey", (F.col("row_position") + 2).alias("sheet_row"))


# =============================================================================
# Warehouse SQL: A1/J7, J4-J6, J8, J9, J11, J12, P12-P14, P16, S4, S7, S12, A15, A16, O1, O2, O5
# =============================================================================
from ..operators import recon as RC  # noqa: E402


@query("a1_customer_summary", sql=f"""
SELECT c.*, count(o.o_orderkey) AS total_orders,
  coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS total_order_value,
  max(o.o_orderdate) AS last_order_date,
  CASE WHEN max(o.o_orderdate) >= TIMESTAMP '{X.AS_OF}' - INTERVAL 3 MONTH THEN 'Active'
       WHEN max(o.o_orderdate) >= TIMESTAMP '{X.AS_OF}' - INTERVAL 12 MONTH THEN 'Inactive'
       ELSE 'Dormant' END AS customer_status
FROM {X.CUSTOMERS_WITH_PROSPECTS_SQL} c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY ALL
""")
def a1_customer_summary(spark, d):
    return RC.customer_summary(X.customers_with_prospects(spark, d), X.orders(spark, d), X.AS_OF)


@query("j8_correlated_count", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus,
  (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS returned_lines
FROM orders o
""")
def j8_correlated_count(spark, d):
    o = X.orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus")
    li = T(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    return RC.count_children(o, li, "o_orderkey", "l_orderkey", "returned_lines")


@query("j4_distinct_join", sql="""
SELECT DISTINCT concat_ws('', CAST(o.o_custkey AS VARCHAR), CAST(TRY_CAST(l.l_orderkey AS BIGINT) AS VARCHAR)) AS rec_id,
  o.o_orderdate, o.o_custkey, l.l_returnflag AS item,
  regexp_replace('T-' || CAST(l.l_suppkey AS VARCHAR) || '-' || l.l_linestatus, '^[^-]*-[^-]*-', '') AS third_name
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
""")
def j4_distinct_join(spark, d):
    o, li = X.orders(spark, d), T(spark, d, "lineitem")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    # distinct with the join key among its columns needs no exchange; the second one, over what is left, merges
    # rows of different orders that get the same record id
    raw = j.select("l_orderkey", "o_orderdate", "o_custkey", F.col("l_returnflag").alias("item"),
                   C.after_second_dash(F.concat(F.lit("T-"), F.col("l_suppkey").cast("string"), F.lit("-"),
                                                F.col("l_linestatus"))).alias("third_name")).distinct()
    return raw.select(C.concat_skip_nulls("o_custkey", F.col("l_orderkey").try_cast("bigint")).alias("rec_id"),
                      "o_orderdate", "o_custkey", "item", "third_name").distinct()


# -- reconciliation load (E4): raw rows, then P12, J5, P16 ---------------------

_RECON_RAW_SQL = """(SELECT
  CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN '' ELSE 'ORD' || CAST(o.o_orderkey AS VARCHAR) END AS id,
  CASE WHEN o.o_orderstatus = 'F' THEN 'CERRADO' ELSE ' ' END AS month,
  CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS collection_date,
  o.o_orderpriority AS account_no,
  CAST(o.o_custkey AS VARCHAR) AS nit_payer,
  CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE CAST(o.o_custkey AS VARCHAR) END AS nit_beneficiary,
  CAST(CAST(floor(o.o_totalprice / 100000) AS BIGINT) AS VARCHAR) AS movement_value,
  CAST(CAST(floor(l.ext / 100000) AS BIGINT) AS VARCHAR) AS captured_value,
  CAST(o.o_orderkey AS VARCHAR) AS package_id,
  CASE WHEN o.o_orderstatus = 'P' THEN ' ' ELSE CAST(o.o_orderkey AS VARCHAR) END AS package_id_captured
FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS ext FROM lineitem GROUP BY 1) l
  ON o.o_orderkey = l.l_orderkey)"""


def _recon_raw(spark, d):
    o = X.orders(spark, d)
    li = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("ext"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    key = F.col("o_orderkey").cast("string")
    return j.select(
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(F.concat(F.lit("ORD"), key)).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "CERRADO").otherwise(" ").alias("month"),
        F.col("o_orderdate").cast("date").cast("string").alias("collection_date"),
        F.col("o_orderpriority").alias("account_no"),
        F.col("o_custkey").cast("string").alias("nit_payer"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.col("o_custkey").cast("string"))
        .alias("nit_beneficiary"),
        F.floor(F.col("o_totalprice") / 100000).cast("bigint").cast("string").alias("movement_value"),
        F.floor(F.col("ext") / 100000).cast("bigint").cast("string").alias("captured_value"),
        key.alias("package_id"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(key).alias("package_id_captured"))


_MONTHS_ES_SQL = "[" + ", ".join(f"'{m}'" for m in K.SPANISH_MONTHS) + "]"

def _sql_p12(src):
    return f"""(SELECT * REPLACE (
    coalesce(CASE WHEN length(rtrim(id)) = 0 THEN NULL ELSE id END, concat_ws('', nit_payer, package_id)) AS id,
    coalesce(CASE WHEN length(rtrim(month)) = 0 THEN NULL ELSE month END,
             list_extract({_MONTHS_ES_SQL}, month(TRY_CAST(collection_date AS DATE)))) AS month,
    TRY_CAST(collection_date AS DATE) AS collection_date)
  FROM {src})"""


_P12_SQL = _sql_p12(_RECON_RAW_SQL)


def _p12(spark, d):
    return RC.default_on_write(_recon_raw(spark, d), "id", ["nit_payer", "package_id"], "month",
                               "collection_date", language="es")


@query("p12_default_on_write", sql=f"SELECT * FROM {_P12_SQL}")
def p12_default_on_write(spark, d):
    return _p12(spark, d)


_MONTH_DIM_SQL = """(SELECT acct, y, m, name FROM (
  SELECT *, row_number() OVER (PARTITION BY acct, y, m ORDER BY name) AS rn FROM (
    SELECT DISTINCT o_orderpriority AS acct, year(o_orderdate) AS y, month(o_orderdate) AS m,
           'CTA ' || o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) AS name
    FROM orders
    UNION ALL
    SELECT DISTINCT o_orderpriority, year(o_orderdate), month(o_orderdate),
           'CTA ' || o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || ' B'
    FROM orders WHERE month(o_orderdate) IN (3, 6))) WHERE rn = 1)"""


def _month_dim(spark, d):
    o = X.orders(spark, d)
    base = o.select(F.col("o_orderpriority").alias("acct"), F.year("o_orderdate").alias("y"),
                    F.month("o_orderdate").alias("m")).distinct()
    name = F.concat(F.lit("CTA "), F.col("acct"), F.lit(" "), F.col("y").cast("string"), F.lit("-"),
                    F.col("m").cast("string"))
    dim = base.withColumn("name", name).unionByName(
        base.filter(F.col("m").isin(3, 6)).withColumn("name", F.concat(name, F.lit(" B"))))
    return RC.dedupe_dimension(dim, ["acct", "y", "m"], ["name"])


_J5_SQL = f"""(SELECT r.*, dm.name AS account_name FROM {_P12_SQL} r
  LEFT JOIN {_MONTH_DIM_SQL} dm ON dm.acct = r.account_no AND dm.y = year(r.collection_date)
   AND dm.m = month(r.collection_date) - 1)"""


def _j5(spark, d):
    return RC.enrich_month(_p12(spark, d), _month_dim(spark, d), "account_no", "collection_date",
                           "acct", "y", "m", "name", "account_name")


@query("j5_month_enrich", sql=f"SELECT * FROM {_J5_SQL}")
def j5_month_enrich(spark, d):
    return _j5(spark, d)


def _sql_check(a, b):
    return (f"CASE WHEN length(rtrim({a})) > 0 AND length(rtrim({b})) > 0 AND {a} = {b} "
            f"THEN 'CORRECTO' ELSE 'INCORRECTO' END")


_P16_PAIRS = {"check_nit": ("nit_payer", "nit_beneficiary"), "check_value": ("movement_value", "captured_value"),
              "check_id": ("package_id", "package_id_captured")}


def _sql_p16(src):
    checks = ", ".join(f"{_sql_check(a, b)} AS {n}" for n, (a, b) in _P16_PAIRS.items())
    all_ok = " AND ".join(f"{_sql_check(a, b)} = 'CORRECTO'" for a, b in _P16_PAIRS.values())
    return (f"SELECT *, {checks}, CASE WHEN {all_ok} THEN 'VALIDADO' ELSE 'INVALIDO' END AS val_check, "
            f"'INVALIDO' AS val_check_lagged FROM {src}")


@query("p16_recon_checks", sql=_sql_p16(_RECON_RAW_SQL))
def p16_recon_checks(spark, d):
    return RC.reconciliation_checks(_recon_raw(spark, d), _P16_PAIRS)


@query("e4_reconciliation_load", sql=_sql_p16(_J5_SQL))
def e4_reconciliation_load(spark, d):
    return RC.reconciliation_checks(_j5(spark, d), _P16_PAIRS)


#: Budget codes of the rows, and their names: some twice (the first name counts), some codes without a name.
_CODES_SQL = """(SELECT 'R' || n AS code, 'Rubro ' || n || ' ' || k AS name
  FROM (SELECT DISTINCT o_orderkey % 9 AS n FROM orders), (SELECT unnest(['b', 'a']) AS k) WHERE n <= 6 AND (k = 'b' OR n % 2 = 0))"""


def _codes(spark, d):
    n = X.orders(spark, d).select((F.col("o_orderkey") % 9).alias("n")).distinct().filter("n <= 6")
    k = n.withColumn("k", F.explode(F.array(F.lit("b"), F.lit("a")))).filter("k = 'b' OR n % 2 = 0")
    return k.select(F.concat(F.lit("R"), F.col("n").cast("string")).alias("code"),
                    F.concat_ws(" ", F.lit("Rubro"), F.col("n").cast("string"), "k").alias("name"))


def _matrix(spark, d):
    code = F.concat(F.lit("R"), (F.col("package_id").cast("bigint") % 9).cast("string"))
    return _p12(spark, d).withColumn("code", code)


def _recon_update(rows, spark, d):
    accounts = _month_dim(spark, d).select(F.col("acct").alias("account"), F.col("y").alias("year"), F.col("m").alias("month"), "name")
    return RC.reconciliation_update(rows, _P16_PAIRS, _codes(spark, d), accounts, "code", "account_no", "collection_date",
                                    {"nit_captured": "nit_payer", "value_captured": "movement_value"})


_MATRIX_SQL = f"(SELECT *, 'R' || CAST(CAST(package_id AS BIGINT) % 9 AS VARCHAR) AS code FROM {_P12_SQL})"


def _sql_update(src, old):
    """One run of the trigger; ``old`` says that the rows carry checks already."""
    checks = ", ".join(f"{_sql_check(a, b)} AS {n}" for n, (a, b) in _P16_PAIRS.items())
    verdict = " AND ".join(f"m.{n} = 'CORRECTO'" for n in _P16_PAIRS) if old else "false"
    drop = "* EXCLUDE (check_nit, check_value, check_id, val_check, nit_captured, value_captured, concept, account_name)" if old else "*"
    return f"""(SELECT m.{drop}, {checks}, CASE WHEN {verdict} THEN 'VALIDADO' ELSE 'INVALIDO' END AS val_check,
      m.nit_payer AS nit_captured, m.movement_value AS value_captured, cd.name AS concept, dm.name AS account_name
    FROM {src} m LEFT JOIN (SELECT code AS c, min(name) AS name FROM {_CODES_SQL} GROUP BY 1) cd ON cd.c = m.code
    LEFT JOIN {_MONTH_DIM_SQL} dm ON dm.acct = m.account_no AND dm.y = year(m.collection_date) AND dm.m = month(m.collection_date) - 1)"""


#: Between the two updates a user corrects captured values of open orders and blanks the packages of some others.
_EDIT_SQL = """(SELECT * REPLACE (
    CASE WHEN CAST(package_id AS BIGINT) % 4 = 0 THEN movement_value ELSE captured_value END AS captured_value,
    CASE WHEN CAST(package_id AS BIGINT) % 5 = 0 THEN '' ELSE package_id_captured END AS package_id_captured) FROM {src})"""


@query("j5_code_join", sql=f"SELECT * FROM {_sql_update(_MATRIX_SQL, False)}")
def j5_code_join(spark, d):
    """The trigger on fresh inserts: checks, captured values, concept by code, account name by month."""
    return _recon_update(_matrix(spark, d), spark, d)


@query("p16_second_update", sql=f"SELECT * FROM {_sql_update(_EDIT_SQL.format(src=_sql_update(_MATRIX_SQL, False)), True)}")
def p16_second_update(spark, d):
    """The trigger again after an edit: the verdict follows the checks from before it."""
    first = _recon_update(_matrix(spark, d), spark, d)
    key = F.col("package_id").cast("bigint")
    edited = first.withColumns({"captured_value": F.when(key % 4 == 0, F.col("movement_value")).otherwise(F.col("captured_value")),
                                "package_id_captured": F.when(key % 5 == 0, "").otherwise(F.col("package_id_captured"))})
    return _recon_update(edited, spark, d)


@query("j6_snowflake", sql="""
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_mktsegment, n.n_name, r.r_name
FROM (SELECT DISTINCT * FROM orders) o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE r.r_name <> '' AND instr(upper(c.c_mktsegment), upper(substr(r.r_name, 1, 1))) > 0
""")
def j6_snowflake(spark, d):
    o = X.orders(spark, d).distinct()
    li = T(spark, d, "lineitem")
    c = T(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation and region are fixed-size code lists (25 and 5 rows): safe to broadcast
    n = F.broadcast(T(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(T(spark, d, "region"))
    j = (o.join(li, o["o_orderkey"] == li["l_orderkey"])
         .join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
         .join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
         .join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left"))
    needle = F.upper(F.substring("r_name", 1, 1))
    return j.filter((F.col("r_name") != "") & (F.instr(F.upper("c_mktsegment"), needle) > 0)) \
        .select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "n_name", "r_name") \
        .orderBy("o_custkey")


@query("j9_bridge_join", sql="""
SELECT p.p_partkey, p.p_name, s.s_suppkey, s.s_name
FROM part p LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON b.l_partkey = p.p_partkey
LEFT JOIN supplier s ON s.s_suppkey = b.l_suppkey
WHERE p.p_size > 25
""")
def j9_bridge_join(spark, d):
    p = T(spark, d, "part").filter(F.col("p_size") > 25).select("p_partkey", "p_name")
    b = T(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = T(spark, d, "supplier").select("s_suppkey", "s_name")
    return (p.join(b, b["l_partkey"] == p["p_partkey"], "left")
            .join(s, s["s_suppkey"] == b["l_suppkey"], "left")
            .select("p_partkey", "p_name", "s_suppkey", "s_name").orderBy("p_partkey", "s_suppkey"))


@query("j11_lookup_default", sql="""
SELECT e.event_id, e.user_name, coalesce(u.uid, 0) AS user_ref
FROM (SELECT event_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS user_name FROM events) e
LEFT JOIN (SELECT c_name, min(c_custkey) AS uid FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' GROUP BY 1) u
  ON u.c_name = e.user_name
""")
def j11_lookup_default(spark, d):
    ev = T(spark, d, "events").select(
        "event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("user_name"))
    users = T(spark, d, "customer").filter(F.col("c_mktsegment") != "AUTOMOBILE")
    return RC.lookup_default(ev, users, "user_name", "c_name", "c_custkey", "user_ref")


_SESSION_AS_OF = "2024-01-20 00:00:00"


@query("j12_active_sessions", sql=f"""
SELECT s.session_id, s.user_id, c.c_name, s.login_time
FROM (SELECT event_id AS session_id, user_id, ts AS login_time, event_type <> 'error' AS is_active FROM events) s
JOIN customer c ON c.c_custkey = s.user_id
WHERE s.is_active AND s.login_time >= TIMESTAMP '{_SESSION_AS_OF}' - INTERVAL 24 HOUR
  AND s.login_time <= TIMESTAMP '{_SESSION_AS_OF}'
""")
def j12_active_sessions(spark, d):
    s = T(spark, d, "events").select(F.col("event_id").alias("session_id"), "user_id",
                                     F.col("ts").alias("login_time"),
                                     (F.col("event_type") != "error").alias("is_active"))
    c = T(spark, d, "customer").select("c_custkey", "c_name")
    return RC.active_sessions(s, c, _SESSION_AS_OF).select("session_id", "user_id", "c_name", "login_time")


@query("p13_phase_durations", sql="""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1, 2)
SELECT day, count(*) AS phases, CAST(sum(floor(epoch_us(e) / 1000) - floor(epoch_us(s) / 1000)) AS BIGINT) AS total_ms,
       round(avg(floor(epoch_us(e) / 1000) - floor(epoch_us(s) / 1000)), 3) AS avg_ms
FROM p GROUP BY day
""")
def p13_phase_durations(spark, d):
    ph = RC.phase_durations(T(spark, d, "events"), "user_id", "ts")
    return ph.groupBy("day").agg(F.count(F.lit(1)).alias("phases"), F.sum("duration_ms").alias("total_ms"),
                                 F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


_EVENT_LABELS = {"click": "Clic", "view": "Vista", "purchase": "Compra"}


@query("p14_decode_labels", sql="""
SELECT CASE event_type WHEN 'click' THEN 'Clic' WHEN 'view' THEN 'Vista' WHEN 'purchase' THEN 'Compra'
       ELSE event_type END AS event_label, count(*) AS n
FROM events GROUP BY 1
""")
def p14_decode_labels(spark, d):
    ev = T(spark, d, "events")
    return ev.groupBy(C.decode("event_type", _EVENT_LABELS).alias("event_label")).agg(F.count(F.lit(1)).alias("n"))


_YEAR_BOUNDS = [f"{y}-01-01" for y in range(1996, 2002)]


@query("s7_range_partitions", sql=f"""
SELECT 1 + {' + '.join(f"CAST(o_orderdate >= TIMESTAMP '{b}' AS INTEGER)" for b in _YEAR_BOUNDS)} AS partition_no,
       count(*) AS n_rows, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date
FROM orders GROUP BY 1
""")
def s7_range_partitions(spark, d):
    o = X.orders(spark, d).withColumn("partition_no", C.range_right_partition("o_orderdate", _YEAR_BOUNDS))
    return o.groupBy("partition_no").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderdate").alias("min_date"),
                                         F.max("o_orderdate").alias("max_date"))


@query("s12_orphans", sql="""
SELECT o_custkey, count(*) AS orphan_rows FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal >= 0 AND c.c_custkey = o.o_custkey)
GROUP BY o_custkey
""")
def s12_orphans(spark, d):
    parent = T(spark, d, "customer").filter(F.col("c_acctbal") >= 0)
    return RC.orphans(X.orders(spark, d), parent, "o_custkey", "c_custkey")


_SUMMARY_TABLES = ["customer", "orders", "lineitem", "part", "supplier"]


@query("s4_source_summary", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS source_name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, "
    f"count(*) > 0 AS has_data FROM {t}" for t in _SUMMARY_TABLES))
def s4_source_summary(spark, d):
    return RC.source_summary({t: T(spark, d, t) for t in _SUMMARY_TABLES})


@query("s4_source_sample", sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def s4_source_sample(spark, d):
    return X.orders(spark, d).orderBy("o_orderkey").limit(5)


@query("a15_batch_counts", sql="SELECT CAST(ts AS DATE) AS batch_day, count(*) AS record_count FROM events GROUP BY 1")
def a15_batch_counts(spark, d):
    return T(spark, d, "events").groupBy(F.to_date("ts").alias("batch_day")).agg(
        F.count(F.lit(1)).alias("record_count"))


@query("a16_distinct_rows", sql="SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def a16_distinct_rows(spark, d):
    return X.orders(spark, d).select("o_custkey", "o_orderstatus").distinct()


@query("o1_order_by", sql="SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def o1_order_by(spark, d):
    return T(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal") \
        .orderBy(F.col("c_acctbal").desc(), "c_custkey")


@query("o2_top_n", sql="SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o2_top_n(spark, d):
    return X.orders(spark, d).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("o5_union_issues", sql=f"""
SELECT rule_name, severity, count(*) AS n FROM (
  SELECT rule_name, severity FROM ({_SHEET_ISSUES_SQL})
  UNION ALL
  SELECT rule_name, severity FROM ({ORACLE['v_issues_documents']})) GROUP BY ALL
""")
def o5_union_issues(spark, d):
    u = _sheet_issues(spark, d).unionByName(v_issues_documents(spark, d))
    return u.groupBy("rule_name", "severity").agg(F.count(F.lit(1)).alias("n"))


# =============================================================================
# Fuzzy linkage: J13 (best match, greedy), A12
# =============================================================================
from ..operators import match as M  # noqa: E402


def _name_words(spark, d):
    """Distinct words of part names (the left list, grows with the vocabulary)."""
    w = T(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select(F.col("word").alias("lid"), F.col("word").alias("lname"))


def _name_variants(spark, d):
    """Right list: each word with a dropped second letter, a prefix, a plural, upper case, reversed."""
    w = T(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    v = (w.select(F.concat(F.substring("w", 1, 1), F.expr("substr(w, 3)")).alias("v"))
         .unionByName(w.select(F.concat(F.lit("x"), F.col("w")).alias("v")))
         .unionByName(w.select(F.concat(F.col("w"), F.lit("s")).alias("v")))
         .unionByName(w.select(F.upper("w").alias("v")))
         .unionByName(w.select(F.reverse("w").alias("v")))).distinct()
    return v.select(F.col("v").alias("rid"), F.col("v").alias("rname"))


_WORDS_SQL = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"
_VARIANTS_SQL = f"""(SELECT DISTINCT v FROM (
  SELECT substr(word, 1, 1) || substr(word, 3) AS v FROM {_WORDS_SQL}
  UNION ALL SELECT 'x' || word FROM {_WORDS_SQL}
  UNION ALL SELECT word || 's' FROM {_WORDS_SQL}
  UNION ALL SELECT upper(word) FROM {_WORDS_SQL}
  UNION ALL SELECT reverse(word) FROM {_WORDS_SQL}))"""
_BEST_SQL = f"""(WITH s AS (SELECT w.word AS lid, r.v AS rid, lower(w.word) AS a, lower(r.v) AS b
                FROM {_WORDS_SQL} w, {_VARIANTS_SQL} r),
  sc AS (SELECT lid, rid, (simple + CASE WHEN contains(b, a) OR contains(a, b) THEN 100.0 ELSE simple END) / 2.0
           AS score
         FROM (SELECT *, 100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1)) AS simple FROM s))
SELECT w.word AS left_id, w.word AS left_name, b.rid AS right_id, round(coalesce(b.score, 0.0) / 100.0, 6) AS confidence
FROM {_WORDS_SQL} w LEFT JOIN (SELECT * FROM sc WHERE score >= {K.LEV_ACCEPT}
  QUALIFY row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid) = 1) b ON b.lid = w.word)"""


@query("j13_fuzzy_best_match", sql=f"SELECT * FROM {_BEST_SQL}")
def j13_fuzzy_best_match(spark, d):
    return M.best_match(_name_words(spark, d), _name_variants(spark, d), "lid", "lname", "rid", "rname")


@query("j13_fuzzy_greedy", sql=f"""
WITH RECURSIVE s AS (SELECT w.word AS lid, r.v AS rid, lower(w.word) AS a, lower(r.v) AS b FROM {_WORDS_SQL} w, {_VARIANTS_SQL} r),
sc AS (SELECT lid, rid, (simple + CASE WHEN contains(b, a) OR contains(a, b) THEN 100.0 ELSE simple END) / 2.0 AS score
       FROM (SELECT *, 100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1)) AS simple FROM s)),
l AS (SELECT word AS lid, row_number() OVER (ORDER BY word) AS i FROM {_WORDS_SQL}),
g(i, used, lid, rid, score) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT l.i, CASE WHEN sc.rid IS NULL THEN g.used ELSE list_append(g.used, sc.rid) END, l.lid, sc.rid, CAST(sc.score AS DOUBLE)
  FROM g JOIN l ON l.i = g.i + 1
  LEFT JOIN sc ON sc.lid = l.lid AND sc.score >= {K.LEV_ACCEPT} AND NOT list_contains(g.used, sc.rid)
  QUALIFY row_number() OVER (ORDER BY sc.score DESC NULLS LAST, sc.rid) = 1)
SELECT lid AS left_id, lid AS left_name, rid AS right_id, round(coalesce(score, 0.0) / 100.0, 6) AS confidence FROM g WHERE i > 0
""")
def j13_fuzzy_greedy(spark, d):
    return M.greedy_match(_name_words(spark, d), _name_variants(spark, d), "lid", "lname", "rid", "rname")


@query("a12_match_stats", sql=f"""
SELECT count(*) AS total_mappings, count(*) FILTER (WHERE confidence >= 0.85) AS high_confidence,
  count(*) FILTER (WHERE confidence >= 0.7 AND confidence < 0.85) AS medium_confidence,
  count(*) FILTER (WHERE confidence > 0 AND confidence < 0.7) AS low_confidence,
  count(*) FILTER (WHERE confidence > 0) AS mapped, round(avg(confidence), 6) AS mean_confidence,
  round(count(*) FILTER (WHERE confidence >= 0.85) / count(*), 6) AS high_confidence_rate,
  round(count(*) FILTER (WHERE confidence >= 0.7 AND confidence < 0.85) / count(*), 6) AS medium_confidence_rate,
  round(count(*) FILTER (WHERE confidence > 0 AND confidence < 0.7) / count(*), 6) AS low_confidence_rate,
  round(count(*) FILTER (WHERE confidence > 0) / count(*), 6) AS mapped_rate
FROM {_BEST_SQL}
""")
def a12_match_stats(spark, d):
    return M.match_stats(j13_fuzzy_best_match(spark, d))


# =============================================================================
# Streaming: T1 T2 T3
# =============================================================================
from ..session import scratch_path  # noqa: E402
from ..streaming import lockout as LO  # noqa: E402
from ..streaming import streams as ST  # noqa: E402

_EVENT_COLS = ["event_type", "value"]


def _events_folder(spark, d):
    """The events table as a folder of files (one input layout for the streams)."""
    path = scratch_path(spark, "events-files")
    ev = T(spark, d, "events")
    ev.repartition(8, F.to_date("ts")).write.mode("overwrite").parquet(path)
    return path, ev.schema


@query("t1_stream_audit", sql=" UNION ALL ".join(
    f"SELECT CAST(event_id AS VARCHAR) AS record_id, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS old_value, "
    f"CAST({c} AS VARCHAR) AS new_value, '{t}' AS data_type FROM events"
    for c, t in [("event_type", "NVARCHAR"), ("value", "FLOAT")]))
def t1_stream_audit(spark, d):
    src, schema = _events_folder(spark, d)
    sink, ckpt = scratch_path(spark, "audit-sink"), scratch_path(spark, "audit-ckpt")
    q = ST.audit_stream(ST.file_stream(spark, src, schema, 2), "event_id", _EVENT_COLS, sink, ckpt,
                        "events", X.AS_OF)
    q.awaitTermination()
    return spark.read.parquet(f"{sink}/details").select("record_id", "column_name", "old_value", "new_value",
                                                       "data_type")


@query("t1_stream_log", sql=f"""
SELECT 'INSERT' AS operation_type, 'events' AS table_name, 'SUCCESS' AS operation_status, 'SYSTEM' AS username,
       TIMESTAMP '{X.AS_OF}' AS operation_timestamp, CAST(count(*) AS BIGINT) AS record_count, CAST(0 AS BIGINT) AS uneven_batches
FROM events
""")
def t1_stream_log(spark, d):
    """The stream's log rows over all batches; a batch is uneven if its details aren't its records times the columns."""
    src, schema = _events_folder(spark, d)
    sink, ckpt = scratch_path(spark, "audit-sink"), scratch_path(spark, "audit-ckpt")
    ST.audit_stream(ST.file_stream(spark, src, schema, 2), "event_id", _EVENT_COLS, sink, ckpt, "events", X.AS_OF).awaitTermination()
    held = spark.read.parquet(f"{sink}/details").groupBy("log_id").agg(F.count("*").alias("details"))
    log = spark.read.parquet(f"{sink}/log").join(held, "log_id", "full")
    even = F.col("details").eqNullSafe(F.col("record_count") * len(_EVENT_COLS))
    return log.groupBy("operation_type", "table_name", "operation_status", "username", "operation_timestamp").agg(
        F.sum("record_count").alias("record_count"), F.count_if(~even).alias("uneven_batches"))


_STREAM_TARGET_CUTOFF = "2024-01-10 00:00:00"


@query("t2_stream_new_records", sql=f"""
SELECT e.* FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t
  WHERE t.ts < TIMESTAMP '{_STREAM_TARGET_CUTOFF}' AND t.event_id = e.event_id)
""")
def t2_stream_new_records(spark, d):
    src, schema = _events_folder(spark, d)
    sink, ckpt = scratch_path(spark, "new-sink"), scratch_path(spark, "new-ckpt")
    target = T(spark, d, "events").filter(F.col("ts") < F.lit(_STREAM_TARGET_CUTOFF).cast("timestamp_ntz"))
    q = ST.new_records_stream(ST.file_stream(spark, src, schema, 2), target, ["event_id"], sink, ckpt)
    q.awaitTermination()
    return spark.read.schema(schema).parquet(sink).select(*schema.fieldNames())


_LOCKOUT_SQL = f"""
WITH RECURSIVE a AS (SELECT user_id, event_id, ts, event_type = 'signup' AS success,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
r AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BOOLEAN) AS success,
    CAST(NULL AS VARCHAR) AS outcome, 0 AS failures, CAST(NULL AS TIMESTAMP) AS locked_until FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL
  SELECT user_id, i, event_id, ts, success,
    CASE WHEN held THEN 'ignored_locked' WHEN success THEN 'success' WHEN n >= {K.LOCK_AFTER_FAILURES} THEN 'locked' ELSE 'failed' END,
    CASE WHEN held THEN failures WHEN success THEN 0 ELSE n END,
    CASE WHEN held THEN locked_until WHEN success THEN NULL
         WHEN n >= {K.LOCK_AFTER_FAILURES} THEN ts + INTERVAL {K.LOCK_MINUTES} MINUTE END
  FROM (SELECT a.*, r.failures, r.locked_until, coalesce(a.ts < r.locked_until, false) AS held,
          CASE WHEN r.locked_until IS NULL THEN r.failures ELSE 0 END + 1 AS n
        FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1))
SELECT user_id, event_id, ts, success, outcome, failures, locked_until FROM r WHERE i > 0
"""


@query("t3_lockout_batch", sql=_LOCKOUT_SQL)
def t3_lockout_batch(spark, d):
    return LO.lockout_batch(LO.login_attempts(T(spark, d, "events")))


# =============================================================================
# Exports, keys and loads: S2 S3 S5 S11 C8 E1 E2
# =============================================================================
from ..sources import exports as EX  # noqa: E402
from ..sources import keys as KY  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from . import pipelines as PL  # noqa: E402

_EXPORT_HEADERS = ["Customer Key!", "  Company   Name ", "Nation#Key", "Acct Bal ($)", "Segment?"]


def _export_folder(spark, d):
    """Customer and orders exported as CSV files, plus a stray non-sheet file."""
    root = scratch_path(spark, "exports")
    EX.write_export(T(spark, d, "customer"), f"{root}/customer", _EXPORT_HEADERS, 4, ["c_custkey"])
    EX.write_export(X.orders(spark, d), f"{root}/orders", None, 4, ["o_orderkey"])
    T(spark, d, "region").select("r_name").write.mode("overwrite").text(f"{root}/notes")
    return root


@query("s2_export_scan", sql="""
SELECT CAST(c_custkey AS VARCHAR) AS "Customer Key", c_name AS "Company Name", CAST(c_nationkey AS VARCHAR) AS "NationKey",
  CAST(c_acctbal AS VARCHAR) AS "Acct Bal ", c_mktsegment AS "Segment", true AS row_ok
FROM customer
""")
def s2_export_scan(spark, d):
    root = _export_folder(spark, d)
    df = EX.read_exports(spark, [f"{root}/customer"], glob="*.csv")
    # each file holds a contiguous ascending key range, so key − (sheet_row − 2) is the file's first key
    first = df.groupBy("source_file").agg(F.min(F.col("Customer Key").cast("bigint")).alias("_first"))
    chk = df.join(first, "source_file")
    ok = (F.col("Customer Key").cast("bigint") - F.col("sheet_row") + 2) == F.col("_first")
    return chk.select("Customer Key", "Company Name", "NationKey", "Acct Bal ", "Segment", ok.alias("row_ok"))


@query("s3_file_admission")
def s3_file_admission(spark, d):
    root = _export_folder(spark, d)
    files = EX.admit_files(EX.list_files(spark, root), max_bytes=10_000_000)
    return files.groupBy("extension", "admitted", "reason").agg(F.count(F.lit(1)).alias("n_files"))


_LINE_CANDIDATES = [("PK_lineitem", "PRIMARY KEY", ["l_orderkey", "l_linenumber"]),
                    ("UQ_line_part", "UNIQUE", ["l_orderkey", "l_linenumber", "l_partkey"]),
                    ("IX_line_all", "UNIQUE INDEX", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                     "l_shipdate"])]


@query("s11_key_candidates", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS key_name, '{k}' AS key_type, '{','.join(c)}' AS key_columns, {KY.PRIORITY[k]} AS priority, "
    f"(SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM lineitem)) "
    f"AS n_distinct, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} "
    f"FROM lineitem)) AS is_unique" for n, k, c in _LINE_CANDIDATES))
def s11_key_candidates(spark, d):
    return KY.verify_candidates(T(spark, d, "lineitem"), _LINE_CANDIDATES)


_ORDER_TEXT_MAPPING = {"order_key": {"target": "order_id", "confidence": 0.9},
                       "cust_key": {"target": "customer_id", "confidence": 0.9},
                       "amount_dot": {"target": "total", "confidence": 0.8},
                       "order_date": {"target": "order_date", "confidence": 0.95},
                       "status_word": {"target": "closed", "confidence": 0.7}}
_ORDER_TEXT_TYPES = {"order_id": "int", "customer_id": "int", "total": "float", "order_date": "datetime",
                     "closed": "boolean"}


def _e1(spark, d):
    return PL.base_load(X.orders_text(spark, d), _ORDER_TEXT_MAPPING, _ORDER_TEXT_TYPES)


_E1_SQL = f"""(SELECT {_INT_SQL.format(c='order_key')} AS order_id, {_INT_SQL.format(c='cust_key')} AS customer_id,
  TRY_CAST(trim(amount_dot) AS DOUBLE) AS total, {_sql_ts('order_date')} AS order_date,
  CASE WHEN lower(trim(status_word)) IN ({_sql_list(K.BOOL_TRUE_WORDS)}) THEN true
       WHEN lower(trim(status_word)) IN ({_sql_list(K.BOOL_FALSE_WORDS)}) THEN false END AS closed
FROM {X.ORDERS_TEXT_SQL})"""


@query("e1_base_load", sql=f"SELECT * FROM {_E1_SQL}")
def e1_base_load(spark, d):
    return _e1(spark, d)


def _holed_orders_text(spark, d):
    """The orders sheet with every column blank for orders of the first day of a month."""
    t = X.orders_text(spark, d)
    blank = F.substring("order_date", 1, 2) == "01"
    return t.select(*[F.when(~blank, F.col(c)).alias(c) for c in t.columns])


@query("e1_load_counts", sql=f"""
SELECT count(*) AS rows_read, count(*) FILTER (WHERE strftime(o_orderdate, '%d') <> '01') AS rows_kept,
       count(*) FILTER (WHERE strftime(o_orderdate, '%d') = '01') AS rows_skipped
FROM orders
""")
def e1_load_counts(spark, d):
    sheet = _holed_orders_text(spark, d)
    return PL.base_load_counts(sheet, PL.base_load(sheet, _ORDER_TEXT_MAPPING, _ORDER_TEXT_TYPES))


def _sheet_folder(spark, d):
    """The orders sheet as files of three layouts (another order with a further column; a column short), with blank
    lines for the first day of a month, and files to reject: text notes, a repeated column."""
    root = scratch_path(spark, "sheets")
    sheet = X.orders_text(spark, d).select("order_key", "cust_key", "amount_dot", "order_date", "status_word")
    part = F.col("order_key").cast("bigint") % 3
    blank = F.substring("order_date", 1, 2) == "01"

    def some(n):
        rows = sheet.filter(part == n)
        return rows.select(*[F.when(~blank, F.col(c)).alias(c) for c in rows.columns])

    EX.write_export(some(0), f"{root}/a", ["Order_Key", "cust_key!", "amount_dot", "order_date", "status_word"], 2, ["order_key"])
    EX.write_export(some(1).select("status_word", "order_date", F.lit(None).cast("string").alias("note"), "amount_dot", "cust_key", "order_key"),
                    f"{root}/b", ["status_word", "order_date", "note, with comma", "amount_dot", "cust_key!", "Order_Key"], 2, ["order_key"])
    EX.write_export(some(2).drop("status_word"), f"{root}/c", ["Order_Key", "cust_key!", "amount_dot", "order_date"], 2, ["order_key"])
    T(spark, d, "region").select("r_name").coalesce(1).write.mode("overwrite").text(f"{root}/notes")
    (spark.createDataFrame([("a,b,a",), ("1,2,3",)], "line string").coalesce(1).write.mode("overwrite")
     .option("header", False).option("quote", "").option("sep", "\u0001").csv(f"{root}/twice"))
    return root


_SHEET_MAPPING = {("Order_Key" if k == "order_key" else "cust_key!" if k == "cust_key" else k): v for k, v in _ORDER_TEXT_MAPPING.items()}
_FILE_SPECS = [R.ColumnSpec("order_id", "order_id", "INTEGER", nullable=False), R.ColumnSpec("customer_id", "customer_id", "INTEGER"),
                R.ColumnSpec("total", "total", "DECIMAL")]


def _file_load(spark, d):
    return PL.file_load(spark, _sheet_folder(spark, d), _SHEET_MAPPING, _ORDER_TEXT_TYPES, _FILE_SPECS, max_bytes=1 << 30)


@query("e1_file_load", sql=f"""
SELECT order_id, customer_id, total, order_date, CASE WHEN order_id % 3 <> 2 THEN closed END AS closed
FROM {_E1_SQL} WHERE strftime(order_date, '%d') <> '01'
""")
def e1_file_load(spark, d):
    return _file_load(spark, d).rows.drop("source_file", "sheet_row")


@query("e1_file_counts", sql="""
SELECT 3 AS layouts, count(*) AS rows_read, count(*) FILTER (WHERE strftime(o_orderdate, '%d') <> '01') AS rows_kept,
       count(*) FILTER (WHERE strftime(o_orderdate, '%d') = '01') AS rows_skipped
FROM orders
""")
def e1_file_counts(spark, d):
    return _file_load(spark, d).counts.select(F.col("layouts").cast("int").alias("layouts"), "rows_read", "rows_kept", "rows_skipped")


@query("e2_enhanced_load", sql=f"""
SELECT e.* FROM {_E1_SQL} e WHERE NOT EXISTS (SELECT 1 FROM orders t
  WHERE t.o_orderdate < TIMESTAMP '{X.TARGET_CUTOFF}' AND t.o_orderkey = e.order_id)
""")
def e2_enhanced_load(spark, d):
    target = X.target_orders(spark, d).select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate")
    cands = [("PK_orders", "PRIMARY KEY", ["order_id"]), ("UQ_cust_date", "UNIQUE", ["o_custkey", "o_orderdate"])]
    return PL.enhanced_load(_e1(spark, d), target, cands, ["order_date", "order_id"])


@query("s5_split_valid_reject", sql=f"""
WITH i AS ({ORACLE['v_issues_nullkey_orders']}),
e AS (SELECT row_number, min(rule_name) AS r FROM i WHERE severity = 'ERROR' GROUP BY 1)
SELECT CASE WHEN e.r IS NULL THEN 'valid' ELSE 'rejected' END AS outcome, e.r AS reject_rule, count(*) AS n_rows
FROM {X.NULLKEY_ORDERS_SQL} o LEFT JOIN e ON e.row_number = o.o_orderkey + 2 GROUP BY ALL
""")
def s5_split_valid_reject(spark, d):
    o = X.nullkey_orders(spark, d)
    issues = R.validate(o, _ORDER_SPECS, F.col("o_orderkey") + 2, _ORDER_CONSTRAINTS, as_of=X.AS_OF)
    valid, rejects = PL.split_valid(o, issues, F.col("o_orderkey") + 2)
    v = valid.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("valid").alias("outcome"), F.lit(None).cast("string").alias("reject_rule"), "n_rows")
    r = rejects.groupBy(F.col("reject_rule")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("rejected").alias("outcome"), "reject_rule", "n_rows")
    return v.unionByName(r).filter(F.col("n_rows") > 0)


@query("c8_load_with_log", sql=f"""
WITH i AS ({ORACLE['v_issues_nullkey_orders']}),
e AS (SELECT DISTINCT row_number FROM i WHERE severity = 'ERROR'),
n AS (SELECT count(*) FILTER (e.row_number IS NULL) AS good, count(*) FILTER (e.row_number IS NOT NULL) AS bad
      FROM {X.NULLKEY_ORDERS_SQL} o LEFT JOIN e ON e.row_number = o.o_orderkey + 2)
SELECT CAST(1 AS BIGINT) AS log_id, 'SYSTEM' AS username, 'BULK_INSERT' AS operation_type, 'Data' AS schema_name, 'orders' AS table_name,
  good AS record_count, CASE WHEN bad > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS operation_status,
  CAST(NULL AS VARCHAR) AS error_message, CAST('{X.AS_OF}' AS TIMESTAMP) AS operation_timestamp FROM n
""")
def c8_load_with_log(spark, d):
    o = X.nullkey_orders(spark, d)
    issues = R.validate(o, _ORDER_SPECS, F.col("o_orderkey") + 2, _ORDER_CONSTRAINTS, as_of=X.AS_OF)
    valid, rejects = PL.split_valid(o, issues, F.col("o_orderkey") + 2)
    log = PL.load_with_log(valid, rejects, scratch_path(spark, "target"), scratch_path(spark, "quarantine"),
                           scratch_path(spark, "oplog"), "orders", X.AS_OF)
    return log.select("log_id", "username", "operation_type", "schema_name", "table_name", "record_count", "operation_status",
                      "error_message", "operation_timestamp")


@query("c2_touch_modified", sql=f"""
SELECT n.o_orderkey, n.o_orderstatus, n.o_totalprice,
  CASE WHEN o.o_orderkey IS NOT NULL AND (o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice)
       THEN CAST('{X.AS_OF}' AS TIMESTAMP) ELSE n.modified_date END AS modified_date
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS modified_date FROM orders) n
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 50000) o ON o.o_orderkey = n.o_orderkey
""")
def c2_touch_modified(spark, d):
    o = T(spark, d, "orders")
    new = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
                   "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp_ntz")).alias("modified_date"))
    old = o.filter(F.col("o_totalprice") > 50000).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return CD.touch_modified(new, old, "o_orderkey", X.AS_OF)


# -- V13 and J14-J18 ---------------------------------------------------------------

@query("v13_mapping_check", sql=" UNION ALL ".join([
    f"""SELECT 'o_custkey_n' AS column_name, 'customer_id' AS target_column, 'INTEGER' AS data_type, count(*) AS n_rows,
      count(*) - count(o_custkey_n) AS n_null, count(o_custkey_n) = 0 AS all_null_warning,
      count(*) - count(o_custkey_n) AS null_into_not_null, 0 AS type_errors, 0 AS length_errors,
      count(*) - count(o_custkey_n) = 0 AS compatible FROM {X.NULLKEY_ORDERS_SQL}""",
    f"""SELECT 'o_orderstatus', 'status', 'BOOLEAN', count(*), 0, false, 0,
      count(*) FILTER (WHERE lower(trim(o_orderstatus)) NOT IN ({_sql_list(K.BOOL_CHECK_WORDS)})), 0,
      count(*) FILTER (WHERE lower(trim(o_orderstatus)) NOT IN ({_sql_list(K.BOOL_CHECK_WORDS)})) = 0
      FROM {X.NULLKEY_ORDERS_SQL}""",
    f"""SELECT 'o_orderpriority', 'priority', 'STRING', count(*), 0, false, 0, 0,
      count(*) FILTER (WHERE length(o_orderpriority) > 8), count(*) FILTER (WHERE length(o_orderpriority) > 8) = 0
      FROM {X.NULLKEY_ORDERS_SQL}""",
    f"""SELECT 'o_totalprice', 'total', 'DECIMAL', count(*), 0, false, 0, 0, 0, true FROM {X.NULLKEY_ORDERS_SQL}""",
]))
def v13_mapping_check(spark, d):
    specs = [s for s in _ORDER_SPECS if s.source in ("o_custkey_n", "o_orderstatus", "o_orderpriority",
                                                    "o_totalprice")]
    return R.mapping_check(X.nullkey_orders(spark, d), specs, ["customer_id"])


def _words_dict(spark, d):
    return _name_words(spark, d).select(F.col("lname").alias("target"))


def _ratio_sql(pairs: str) -> str:
    """(x, y, r): the indel ratio of each pair of texts in ``pairs`` (x, y), by a bit-parallel common subsequence: one
    step per letter of y on a whole number that holds a bit per letter of x."""
    return f"""(SELECT x, y, CASE WHEN x = '' AND y = '' THEN 100.0 ELSE round_even(200.0 * (length(x) - bit_count(free)) / (length(x) + length(y)), 0) END AS r
  FROM (SELECT x, y, list_reduce(list_prepend(last, masks), lambda f, m: ((f + (f & m)) | (f - (f & m))) & last) AS free
    FROM (SELECT x, y, (1::BIGINT << length(x)) - 1 AS last, list_transform(string_split(y, ''), lambda ch:
            coalesce(list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN x[i] = ch THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0)::BIGINT) AS masks
          FROM {pairs})))"""


def _weighted_sql(weights, threshold: float, bonus: bool, key) -> str:
    """The greedy one-to-one linkage of name variants to words; both are single words, so the token scorers are the ratio."""
    w = weights
    plus = "0"
    if bonus:
        def hit(c, words):
            return f"regexp_matches({c}, '{'|'.join(words)}')"
        n = len(K.PATTERN_FAMILIES)
        both = [f"({hit('a', ws)} AND {hit('b', ws)})" for _, ws in K.PATTERN_FAMILIES]
        one = [f"({hit('a', ws)} <> {hit('b', ws)})" for _, ws in K.PATTERN_FAMILIES]
        small = " + ".join(f"CASE WHEN {one[i]} AND NOT ({' OR '.join(both[:i]) or 'false'}) THEN {K.BONUS_ONE} ELSE 0 END" for i in range(n))
        gap = "abs(length(a) - length(b))"
        plus = (f"least({K.BONUS_CAP}, {small} + CASE WHEN {' OR '.join(both)} THEN {K.BONUS_BOTH} ELSE 0 END + "
                f"CASE WHEN {gap} <= 2 THEN {K.BONUS_GAP_2} WHEN {gap} <= 5 THEN {K.BONUS_GAP_5} ELSE 0 END)")
    return f"""
WITH RECURSIVE p AS (SELECT v.v AS lid, w.word AS rid, {key('v.v')} AS a, {key('w.word')} AS b FROM {_VARIANTS_SQL} v, {_WORDS_SQL} w),
s AS (SELECT DISTINCT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM p),
u AS (SELECT x, y, substr(y, i, length(x)) AS piece FROM (SELECT x, y, unnest(range(1, length(y) + 1)) AS i FROM s)),
q AS (SELECT u.x, u.y, max(r) AS part FROM u JOIN {_ratio_sql("(SELECT DISTINCT x, piece AS y FROM u)")} z ON z.x = u.x AND z.y = u.piece GROUP BY ALL),
r AS (SELECT z.x, z.y, z.r, q.part FROM {_ratio_sql("s")} z JOIN q ON q.x = z.x AND q.y = z.y),
raw AS (SELECT lid, rid, r.r * {w[0]} + r.part * {w[1]} + r.r * {w[2]} + r.r * {w[3]} AS plain, {plus} AS plus
  FROM p JOIN r ON r.x = CASE WHEN length(a) <= length(b) THEN a ELSE b END AND r.y = CASE WHEN length(a) <= length(b) THEN b ELSE a END),
sc AS (SELECT lid, rid, least(100.0, plain + plus) AS score FROM raw WHERE plain + plus >= {threshold}),
best AS (SELECT lid, max(plain) AS best FROM raw GROUP BY 1),
l AS (SELECT v AS lid, row_number() OVER (ORDER BY v) AS i FROM {_VARIANTS_SQL}),
g(i, used, lid, rid, score) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT l.i, CASE WHEN sc.rid IS NULL THEN g.used ELSE list_append(g.used, sc.rid) END, l.lid, sc.rid, CAST(sc.score AS DOUBLE)
  FROM g JOIN l ON l.i = g.i + 1
  LEFT JOIN sc ON sc.lid = l.lid AND NOT list_contains(g.used, sc.rid)
  QUALIFY row_number() OVER (ORDER BY sc.score DESC NULLS LAST, sc.rid) = 1)
SELECT g.lid AS left_id, g.lid AS left_name, rid AS target_name, round(coalesce(score, 0.0) / 100.0, 6) AS confidence,
  CASE WHEN score >= {K.LINK_HIGH} THEN 'exact_match' WHEN score IS NOT NULL THEN 'fuzzy_match' END AS match_type,
  round(greatest(best, score) / 100.0, 6) AS best_score
FROM g JOIN best ON best.lid = g.lid WHERE i > 0
"""


def _normal_sql(c: str) -> str:
    v = f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
    v = f"regexp_replace({v}, '^({'|'.join(K.NAME_PREFIXES)})(.)', '\\2')"
    return f"regexp_replace({v}, '(.)({'|'.join(K.NAME_SUFFIXES)})$', '\\1')"


@query("j14_weighted_link", sql=_weighted_sql(K.LINK_WEIGHTS, K.LINK_ACCEPT, True, _normal_sql))
def j14_weighted_link(spark, d):
    return M.weighted_link(_name_variants(spark, d), _words_dict(spark, d), "rid", "rname", "target")


@query("j15_weighted_link_plain", sql=_weighted_sql(K.LINK_WEIGHTS_EARLY, K.LINK_EARLY_ACCEPT, False, lambda c: f"lower({c})"))
def j15_weighted_link_plain(spark, d):
    return M.weighted_link(_name_variants(spark, d), _words_dict(spark, d), "rid", "rname", "target",
                           weights=K.LINK_WEIGHTS_EARLY, threshold=K.LINK_EARLY_ACCEPT, bonus=False,
                           normalise=False)


@query("j16_close_matches")
def j16_close_matches(spark, d):
    return M.close_matches(_name_variants(spark, d), _words_dict(spark, d), "rid", "rname", "target")


@query("j16_best_target")
def j16_best_target(spark, d):
    return M.best_target(_name_variants(spark, d), _words_dict(spark, d), "rid", "rname", "target")


#: Full labels of parts, as another system writes them: type, brand and the words of the name in reverse (thousands at scale).
_LABELS_SQL = """(SELECT DISTINCT concat_ws(' ', p_type, p_brand, list_aggregate(list_reverse(string_split(p_name, ' ')), 'string_agg', ' ')) AS label
  FROM part)"""


def _sorted_words_sql(c: str) -> str:
    return f"list_aggregate(list_sort(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]', ' ', 'g'), ' '), lambda t: t <> '')), 'string_agg', ' ')"


@query("j17_alternatives", sql=f"""
WITH p AS (SELECT l.label, n.p_name, {_sorted_words_sql('l.label')} AS x, {_sorted_words_sql('n.p_name')} AS y
  FROM {_LABELS_SQL} l, (SELECT DISTINCT p_name FROM part WHERE NOT starts_with(p_name, 'small')) n),
s AS (SELECT label, p_name, r AS score FROM p JOIN {_ratio_sql("(SELECT DISTINCT x, y FROM p)")} z ON z.x = p.x AND z.y = p.y
  WHERE r >= {K.ALTERNATIVE_MIN})
SELECT label AS left_id, label AS left_name, CAST(row_number() OVER w AS INTEGER) AS rank, p_name AS target_name, score
FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, p_name) QUALIFY row_number() OVER w <= {K.ALTERNATIVES}
""")
def j17_alternatives(spark, d):
    p = T(spark, d, "part")
    label = F.concat_ws(" ", "p_type", "p_brand", F.array_join(F.reverse(F.split("p_name", " ")), " "))
    labels = p.select(label.alias("label")).distinct().select(F.col("label").alias("lid"), F.col("label").alias("lname"))
    taken = p.select("p_name").filter(F.col("p_name").startswith("small")).distinct()
    return M.alternatives(labels, p.select(F.col("p_name").alias("target")).distinct(), "lid", "lname", "target", taken)


@query("j18_group_similarity")
def j18_group_similarity(spark, d):
    p = T(spark, d, "part")
    members = p.select("p_brand", F.explode(F.split("p_name", " ")).alias("word"))
    targets = p.select("p_type", F.explode(F.split("p_name", " ")).alias("word"))
    return M.group_similarity(members, "p_brand", "word", targets, "p_type", "word")


@query("j7_order_summary_view", sql="""
SELECT c.c_custkey, c.c_name, c.c_mktsegment, count(o.o_orderkey) AS total_orders,
  coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS total_order_value, max(o.o_orderdate) AS last_order_date
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
WHERE c.c_acctbal >= 0
GROUP BY c.c_custkey, c.c_name, c.c_mktsegment
""")
def j7_order_summary_view(spark, d):
    active = T(spark, d, "customer").filter(F.col("c_acctbal") >= 0).select("c_custkey", "c_name", "c_mktsegment")
    s = RC.customer_summary(active, X.orders(spark, d), X.AS_OF)
    return s.drop("customer_status")


@query("e3_quality_report_orders", sql=f"""
WITH i AS ({ORACLE['v_issues_nullkey_orders']}), n AS (SELECT count(*) AS processed_rows FROM {X.NULLKEY_ORDERS_SQL}),
s AS (SELECT count(*) FILTER (WHERE severity = 'ERROR') AS error_count,
             count(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
             count(*) FILTER (WHERE severity = 'INFO') AS info_count,
             count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
             count(DISTINCT CASE WHEN severity = 'ERROR' AND row_number > 0 THEN row_number END) AS rows_with_errors
      FROM i)
SELECT processed_rows, error_count, warning_count, info_count, critical_count,
  round(error_count / processed_rows, 6) AS error_rate, error_count / processed_rows <= {K.MAX_ERROR_RATE} AS is_valid,
  processed_rows - error_count AS valid_rows, processed_rows - rows_with_errors AS rows_without_errors,
  error_count / processed_rows > {K.MAX_ERROR_RATE} AS high_error_rate_warning
FROM n, s
""")
def e3_quality_report_orders(spark, d):
    _, verdict = PL.quality_report(X.nullkey_orders(spark, d), _ORDER_SPECS, F.col("o_orderkey") + 2,
                                   _ORDER_CONSTRAINTS, as_of=X.AS_OF)
    return verdict


# -- option variants: J5 roll_year, A8 all rows, J1 with a collation --------------------------

_J5_ROLLED_SQL = f"""(SELECT r.*, dm.name AS account_name FROM {_P12_SQL} r
  LEFT JOIN {_MONTH_DIM_SQL} dm ON dm.acct = r.account_no
   AND dm.y = year(r.collection_date - INTERVAL 1 MONTH) AND dm.m = month(r.collection_date - INTERVAL 1 MONTH))"""


@query("j5_month_enrich_rolled", sql=f"SELECT * FROM {_J5_ROLLED_SQL}")
def j5_month_enrich_rolled(spark, d):
    return RC.enrich_month(_p12(spark, d), _month_dim(spark, d), "account_no", "collection_date",
                           "acct", "y", "m", "name", "account_name", roll_year=True)


@query("a8_kind_all_rows", sql=_sql_kind(X.CUSTOMER_SHEET_SQL, _SHEET_COLS, "customer_id"))
def a8_kind_all_rows(spark, d):
    s = X.customer_sheet(spark, d).withColumn("_k", F.col("customer_id"))
    return TY.semantic_kind(s, ["_k"], _SHEET_COLS, sample_rows=None)


@query("j1_filter_new_collated", sql="""
SELECT i.* FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name
                 FROM customer) i
WHERE NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_acctbal > 0 AND lower(t.c_name) = lower(i.c_name))
""")
def j1_filter_new_collated(spark, d):
    c = T(spark, d, "customer")
    incoming = c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.upper("c_name"))
                        .otherwise(F.col("c_name")).alias("c_name"))
    target = c.filter(F.col("c_acctbal") > 0).select("c_name")
    # case-insensitive key comparison, as a case-insensitive target database would do
    out = I.filter_new(incoming, target, ["c_name"], collation="UTF8_LCASE")
    return out.select("c_custkey", F.col("c_name").cast("string").alias("c_name"))


@query("t3_lockout_stream", sql=_LOCKOUT_SQL)
def t3_lockout_stream(spark, d):
    """T3 as a stream: attempts come in files that are not in time order, up to a month late; a closing
    heartbeat moves the watermark past the last attempt."""
    src, schema = _events_folder(spark, d)
    last = T(spark, d, "events").agg(F.max("ts").alias("ts"))
    heartbeat = last.select(*[(F.col("ts") + F.expr("INTERVAL 63 DAYS") if c == "ts" else F.lit("error") if c == "event_type"
                               else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.fieldNames()])
    heartbeat.write.mode("append").parquet(src)
    stream = LO.login_attempts(ST.file_stream(spark, src, schema, 2))
    sink, ckpt = scratch_path(spark, "lock-sink"), scratch_path(spark, "lock-ckpt")
    with ST.rocksdb_state(spark):
        q = (LO.lockout_stream(stream, "62 days").writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


# =============================================================================
# Whole loads: E2 totals, E4 from its distinct join, J6's chain, the log's layout, written tables
# =============================================================================

_REPEATED_SQL = f"(SELECT * FROM {_E1_SQL} UNION ALL SELECT * FROM {_E1_SQL} WHERE order_id % 7 = 0)"


@query("e2_load_totals", sql=f"""
WITH b AS {_REPEATED_SQL}, k AS (SELECT DISTINCT order_id FROM b),
f AS (SELECT EXISTS (SELECT 1 FROM {X.TARGET_ORDERS_SQL} t WHERE t.o_orderkey = k.order_id) AS old FROM k)
SELECT (SELECT count(*) FROM b) AS rows_read, (SELECT count(*) FROM b) - count(*) AS duplicates_in_batch,
  count(*) FILTER (old) AS existing, count(*) FILTER (NOT old) AS inserted FROM f
""")
def e2_load_totals(spark, d):
    """E2's totals over a batch in which every seventh order comes twice."""
    batch, target = _e1(spark, d), X.target_orders(spark, d).select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate")
    batch = batch.unionByName(batch.filter("order_id % 7 = 0"))
    cands = [("PK_orders", "PRIMARY KEY", ["order_id"]), ("UQ_cust_date", "UNIQUE", ["o_custkey", "o_orderdate"])]
    return PL.enhanced_load_totals(batch, target, cands, ["order_date", "order_id"]).counts


_CAPTURES_SQL = """(SELECT CAST(o_custkey AS VARCHAR) AS id_number, lpad(CAST(o_orderkey AS VARCHAR), 13, '0') AS capture_id,
  o_orderpriority AS account_no, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS collection_date, 'ENTIDAD ' || o_orderstatus AS payer_name,
  CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) AS value FROM orders)"""
_BUDGET_SQL = """(SELECT lpad(CAST(l_orderkey AS VARCHAR), 13, '0') AS invoice,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS third_id,
  'T-' || CAST(l_suppkey AS VARCHAR) || '-' || l_linestatus AS third_name,
  CAST(CAST(floor(l_extendedprice / 50000) AS BIGINT) AS VARCHAR) AS value, 'R' || CAST(l_partkey % 9 AS VARCHAR) AS code,
  l_linenumber AS line_no, 'PAGO ' || upper(p_name) AS description FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
_PAYMENTS_SQL = f"""(SELECT DISTINCT concat_ws('', p.id_number, CAST(TRY_CAST(p.capture_id AS BIGINT) AS VARCHAR)) AS id, '' AS month,
  p.account_no, p.collection_date, p.id_number AS nit_payer, p.payer_name, p.value AS movement_value, b.third_id AS nit_beneficiary,
  regexp_replace(b.third_name, '^[^-]*-[^-]*-', '') AS third_name, b.value AS captured_value, b.code,
  p.capture_id AS package_id_captured, b.invoice AS package_id
  FROM {_CAPTURES_SQL} p JOIN {_BUDGET_SQL} b ON p.capture_id = b.invoice)"""


def _captures(spark, d):
    o = X.orders(spark, d)
    return o.select(F.col("o_custkey").cast("string").alias("id_number"), F.lpad(F.col("o_orderkey").cast("string"), 13, "0").alias("capture_id"),
                    F.col("o_orderpriority").alias("account_no"), F.col("o_orderdate").cast("date").cast("string").alias("collection_date"),
                    F.concat(F.lit("ENTIDAD "), "o_orderstatus").alias("payer_name"),
                    F.floor(F.col("o_totalprice") / 50000).cast("bigint").cast("string").alias("value"))


def _budget(spark, d):
    supp, part = F.col("l_suppkey").cast("string"), T(spark, d, "part").select("p_partkey", "p_name")
    return T(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.lpad(F.col("l_orderkey").cast("string"), 13, "0").alias("invoice"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(supp).alias("third_id"),
        F.concat(F.lit("T-"), supp, F.lit("-"), "l_linestatus").alias("third_name"),
        F.floor(F.col("l_extendedprice") / 50000).cast("bigint").cast("string").alias("value"),
        F.concat(F.lit("R"), (F.col("l_partkey") % 9).cast("string")).alias("code"), F.col("l_linenumber").alias("line_no"),
        F.concat(F.lit("PAGO "), F.upper("p_name")).alias("description"))


@query("e4_whole_load", sql=f"SELECT * FROM {_sql_update(_sql_p12(_PAYMENTS_SQL), False)}")
def e4_whole_load(spark, d):
    """E4 from its sources: distinct join, defaults on write, then the trigger with both joins and captured values."""
    accounts = _month_dim(spark, d).select(F.col("acct").alias("account"), F.col("y").alias("year"), F.col("m").alias("month"), "name")
    return RC.reconciliation_load(_captures(spark, d), _budget(spark, d), _codes(spark, d), accounts, _P16_PAIRS,
                                  {"nit_captured": "nit_payer", "value_captured": "movement_value"})


#: Source dimensions by budget code: codes 7 and 8 have no group, 6 no subgroup, some subgroups no concept, code 4 no type.
_LEVELS_SQL = """levels AS (SELECT 'R' || CAST(n AS VARCHAR) AS code, n, s, n % 3 AS group_key, (n % 3) * 10 + s AS subgroup_key,
  'C' || CAST((n % 3) * 10 + s AS VARCHAR) AS concept_key, CASE WHEN s = 1 THEN 'Widget' ELSE 'Bolt' END AS type_name
  FROM (SELECT DISTINCT l_partkey % 9 AS n FROM lineitem), (SELECT unnest([1, 2]) AS s)),
chain AS (SELECT p.capture_id, b.line_no, b.third_id, b.code, b.description, g.group_key, sb.subgroup_key, c.concept_key, t.type_name,
    (g.code IS NOT NULL)::INT + (sb.code IS NOT NULL)::INT + (c.code IS NOT NULL)::INT + (t.code IS NOT NULL)::INT AS levels_matched
  FROM (SELECT DISTINCT * FROM {captures}) p JOIN {budget} b ON p.capture_id = b.invoice
  LEFT JOIN (SELECT DISTINCT code, group_key FROM levels WHERE n <= 6) g ON g.code = b.code
  LEFT JOIN (SELECT code, group_key, subgroup_key FROM levels WHERE n <= 5) sb ON sb.group_key = g.group_key AND sb.code = b.code
  LEFT JOIN (SELECT code, subgroup_key, concept_key FROM levels WHERE s = 1 OR n <= 2) c ON c.subgroup_key = sb.subgroup_key AND c.code = b.code
  LEFT JOIN (SELECT code, concept_key, type_name FROM levels WHERE n <> 4) t ON t.concept_key = c.concept_key AND t.code = b.code)
""".format(captures=_CAPTURES_SQL, budget=_BUDGET_SQL)


def _chain(spark, d):
    n, s = F.col("n"), F.col("s")
    levels = (T(spark, d, "lineitem").select((F.col("l_partkey") % 9).alias("n")).distinct()
              .withColumn("s", F.explode(F.array(F.lit(1), F.lit(2))))
              .select("n", "s", F.concat(F.lit("R"), n.cast("string")).alias("code"), (n % 3).alias("group_key"),
                      ((n % 3) * 10 + s).alias("subgroup_key"), F.concat(F.lit("C"), ((n % 3) * 10 + s).cast("string")).alias("concept_key"),
                      F.when(s == 1, "Widget").otherwise("Bolt").alias("type_name")))
    budget = _budget(spark, d).select("invoice", "line_no", "third_id", "code", "description")
    rows = _captures(spark, d).distinct().select("capture_id").join(budget, F.col("capture_id") == F.col("invoice")).drop("invoice")
    return RC.dimension_chain(rows, [
        (levels.filter("n <= 6").select("code", "group_key").distinct(), [("code", "code")], {"group_key": "group_key"}),
        (levels.filter("n <= 5"), [("group_key", "group_key"), ("code", "code")], {"subgroup_key": "subgroup_key"}),
        (levels.filter("s = 1 OR n <= 2"), [("subgroup_key", "subgroup_key"), ("code", "code")], {"concept_key": "concept_key"}),
        (levels.filter("n <> 4"), [("concept_key", "concept_key"), ("code", "code")], {"type_name": "type_name"})])


@query("j6_budget_chain", sql=f"""
WITH {_LEVELS_SQL} SELECT * FROM chain WHERE type_name <> '' AND instr(description, upper(type_name)) > 0
""")
def j6_budget_chain(spark, d):
    """Four left joins, three of them on two columns, and the record type named in the line's description."""
    return RC.mentioned(_chain(spark, d), "type_name", "description").orderBy("third_id")


@query("j6_chain_depth", sql=f"WITH {_LEVELS_SQL} SELECT levels_matched, count(*) AS n_rows FROM chain GROUP BY 1")
def j6_chain_depth(spark, d):
    """Rows by the number of levels they matched: those that the chain's filter drops are counted here."""
    return _chain(spark, d).groupBy("levels_matched").agg(F.count("*").alias("n_rows"))


@query("c5_log_appended", sql=f"""
WITH e AS (SELECT 1 AS batch_id, 'INSERT' AS operation_type, count(*) AS record_count, 'orders.csv' AS source_file
    FROM orders o WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM {X.TARGET_ORDERS_SQL})
  UNION ALL SELECT 2, change_type, count(*), NULL FROM {_CLASSIFY_SQL} WHERE change_type <> 'UNCHANGED' GROUP BY change_type)
SELECT CAST(row_number() OVER (ORDER BY batch_id, operation_type) AS BIGINT) AS log_id, batch_id, 'SYSTEM' AS username, operation_type,
  'Data' AS schema_name, 'orders' AS table_name, record_count, 'SUCCESS' AS operation_status,
  TIMESTAMP '{X.AS_OF}' AS operation_timestamp, 'gridload' AS application_name, CAST(NULL AS VARCHAR) AS session_id,
  CAST(7 AS INTEGER) AS user_id, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS INTEGER) AS execution_time_ms, source_file,
  CAST(NULL AS VARCHAR) AS worksheet_name, CAST(NULL AS VARCHAR) AS ip_address,
  'rows=' || CAST(record_count AS VARCHAR) AS additional_info FROM e
""")
def c5_log_appended(spark, d):
    """Two batches appended to a log in its whole layout, the second one twice: ids stay dense, nothing doubles."""
    path = scratch_path(spark, "operation-log")
    common = {"user_id": F.lit(7), "additional_info": F.concat(F.lit("rows="), F.col("record_count").cast("string"))}
    loaded = CD.log_entries(_new_orders(spark, d), [], "INSERT", "orders", X.AS_OF, {**common, "source_file": F.lit("orders.csv")})
    CD.append_log(loaded, path, 1)
    changed = c4_classify_changes(spark, d).filter(F.col("change_type") != "UNCHANGED")
    changes = CD.log_entries(changed, ["change_type"], F.col("change_type"), "orders", X.AS_OF, common)
    CD.append_log(changes, path, 2)
    return CD.append_log(changes, path, 2)


@query("s6_bucket_upsert", sql=f"""
WITH c AS (SELECT * REPLACE ('X' AS o_orderstatus) FROM orders WHERE o_orderkey % 97 = 0)
SELECT * FROM {X.TARGET_ORDERS_SQL} t WHERE t.o_orderkey NOT IN (SELECT o_orderkey FROM c) UNION ALL SELECT * FROM c
""")
def s6_bucket_upsert(spark, d):
    """The target written in key buckets, then changed and new orders merged in place; read back."""
    path, buckets = scratch_path(spark, "bucketed-orders"), spark.sparkContext.defaultParallelism * 4
    SK.write_buckets(X.target_orders(spark, d), path, ["o_orderkey"], buckets)
    changes = X.orders(spark, d).filter("o_orderkey % 97 = 0").withColumn("o_orderstatus", F.lit("X"))
    SK.upsert_buckets(changes, path, ["o_orderkey"], buckets)
    return spark.read.parquet(path).drop("bucket")


_SPLIT_SPECS = [R.ColumnSpec("o_custkey_n", "customer_id", "INTEGER", nullable=False),
                R.ColumnSpec("o_orderpriority", "priority", "STRING", max_length=8)]


@query("s5_written_split", sql=f"""
SELECT CASE WHEN r IS NULL THEN 'valid' ELSE 'rejected' END AS outcome, r AS reject_rule, count(*) AS n_rows FROM (
  SELECT CASE WHEN o_custkey_n IS NULL THEN 'not_null_constraint' WHEN length(o_orderpriority) > 8 THEN 'string_length' END AS r
  FROM {X.NULLKEY_ORDERS_SQL}) GROUP BY ALL
""")
def s5_written_split(spark, d):
    """S5 through its sinks: valid rows and rejects written to their tables and counted there; the issues are staged once."""
    o, target, quarantine = X.nullkey_orders(spark, d), scratch_path(spark, "valid"), scratch_path(spark, "rejects")
    found = R.validate(o, _SPLIT_SPECS, F.col("o_orderkey") + 2, {"not_null_columns": ["customer_id"]}, as_of=X.AS_OF)
    at = scratch_path(spark, "issues")
    found.write.parquet(at)
    issues = spark.read.schema(found.schema).parquet(at)
    SK.append_with_quarantine(*PL.split_valid(o, issues, F.col("o_orderkey") + 2), target, quarantine)
    rows = (spark.read.parquet(target).select(F.lit("valid").alias("outcome"), F.lit(None).cast("string").alias("reject_rule"))
            .unionByName(spark.read.parquet(quarantine).select(F.lit("rejected").alias("outcome"), "reject_rule")))
    return rows.groupBy("outcome", "reject_rule").agg(F.count("*").alias("n_rows"))


@query("s7_written_partitions", sql=f"SELECT * FROM ({ORACLE['s7_range_partitions']}) WHERE partition_no >= 3")
def s7_written_partitions(spark, d):
    """S7 through its sink: written by range number, then only the folders of later ranges are read."""
    path = scratch_path(spark, "ranges")
    SK.write_range_partitioned(X.orders(spark, d), "o_orderdate", path, _YEAR_BOUNDS)
    return spark.read.parquet(path).filter("partition_no >= 3").groupBy("partition_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderdate").alias("min_date"), F.max("o_orderdate").alias("max_date"))


def _sql_type(c):
    return f"(SELECT CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof({c})) END FROM {X.CUSTOMER_SHEET_SQL} LIMIT 1)"


@query("a2_column_report", sql=f"""
SELECT p.*, CASE column_name {' '.join(f"WHEN '{c}' THEN {_sql_type(c)}" for c in _SHEET_COLS)} END AS data_type, k.inferred_kind
FROM ({_sql_profile(X.CUSTOMER_SHEET_SQL, _SHEET_COLS)}) p
JOIN ({_sql_kind(X.CUSTOMER_SHEET_SQL, _SHEET_COLS, "customer_id")}) k USING (column_name)
""")
def a2_column_report(spark, d):
    return PR.column_report(X.customer_sheet(spark, d).withColumn("_k", F.col("customer_id")), ["_k"], _SHEET_COLS)


#: Cells of wrong types among right ones, and dates before, beyond and too far ahead.
_CELLS_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '12d' WHEN o_orderkey % 3 = 1 THEN '1,200' ELSE CAST(o_orderkey AS VARCHAR) END AS pieces,
  CASE WHEN o_orderkey % 4 = 0 THEN 'x1' ELSE '10.5' END AS weight, CASE WHEN o_orderkey % 5 = 0 THEN 'no date' ELSE '1997-01-05' END AS day_text,
  o_orderdate + CASE o_orderkey % 7 WHEN 0 THEN INTERVAL 150 YEARS WHEN 1 THEN INTERVAL 90 YEARS WHEN 2 THEN INTERVAL (-120) YEARS
    ELSE INTERVAL 0 YEARS END AS due FROM orders)"""
_CELL_SPECS = [R.ColumnSpec("pieces", "pieces", "INTEGER"), R.ColumnSpec("weight", "weight", "DECIMAL"),
               R.ColumnSpec("day_text", "day_text", "DATE"), R.ColumnSpec("due", "due", "DATETIME")]
_RANGE_SQL = f"(due < TIMESTAMP '{K.DATE_RANGE_MIN}' OR due > TIMESTAMP '{K.DATE_RANGE_MAX}')"


@query("v_issues_cells", sql=" UNION ALL ".join([
    _issue_sql("o_orderkey + 2", c, c, "data_type_validation", _q(m), "ERROR", f"Convert to type {t}", _CELLS_SQL, w)
    for c, t, m, w in [("pieces", "INTEGER", "Not a valid integer", "pieces = '12d'"),
                       ("weight", "DECIMAL", "Not a valid decimal number", "weight = 'x1'"),
                       ("day_text", "DATE", "Not a valid date/time", "day_text = 'no date'")]] + [
    _issue_sql("o_orderkey + 2", "due", "due", "date_range",
               f"CASE WHEN {_RANGE_SQL} THEN 'Date outside the valid range (1900-2100)' ELSE 'Date too far in the future' END", "WARNING",
               None, _CELLS_SQL, f"{_RANGE_SQL} OR due > TIMESTAMP '{X.AS_OF}' + INTERVAL {K.FUTURE_YEARS} YEARS")]))
def v_issues_cells(spark, d):
    """V5 and V8's integer, decimal and date branches."""
    key = F.col("o_orderkey")
    years = F.when(key % 7 == 0, 150).when(key % 7 == 1, 90).when(key % 7 == 2, -120).otherwise(0)
    cells = X.orders(spark, d).select(
        key, F.when(key % 3 == 0, "12d").when(key % 3 == 1, "1,200").otherwise(key.cast("string")).alias("pieces"),
        F.when(key % 4 == 0, "x1").otherwise("10.5").alias("weight"), F.when(key % 5 == 0, "no date").otherwise("1997-01-05").alias("day_text"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_ym_interval(years)).alias("due"))
    return R.validate(cells, _CELL_SPECS, key + 2, as_of=X.AS_OF, structure=False)
