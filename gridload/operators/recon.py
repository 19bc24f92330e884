"""Warehouse SQL re-expressed: customer summary, correlated counts, reconciliation
load (distinct join → default-on-write → dimension enrichment → checks),
snowflake joins, bridge joins, lookups and sessions.

Scale notes: facts are pre-aggregated on their join key before meeting a
dimension (partial aggregation absorbs a hot key); dimensions are
broadcast only when their size is bounded by construction (the fixed
region/nation code lists); everything else is left to AQE, which
broadcasts a side only after measuring it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


def customer_summary(customers: DataFrame, orders: DataFrame, as_of: str,
                     cust_key: str = "c_custkey", order_cust: str = "o_custkey",
                     amount: str = "o_totalprice", date: str = "o_orderdate") -> DataFrame:
    """Orders per customer, total value (0 when none), last order date and
    Active (≥ as_of − 3 months) / Inactive (≥ as_of − 12 months) / Dormant."""
    per = orders.groupBy(F.col(order_cust).alias("_ck")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(38,2)").alias("_sum"),
        F.max(date).alias("last_order_date"))
    j = customers.join(per, customers[cust_key] == per["_ck"], "left")
    ts = F.lit(as_of).cast("timestamp_ntz")
    last = F.col("last_order_date")
    status = (F.when(last >= ts - F.expr(f"INTERVAL {K.ACTIVE_MONTHS} MONTHS"), "Active")
              .when(last >= ts - F.expr(f"INTERVAL {K.INACTIVE_MONTHS} MONTHS"), "Inactive").otherwise("Dormant"))
    return j.select(*[customers[c] for c in customers.columns],
                    F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
                    F.coalesce("_sum", F.lit(0).cast("decimal(38,2)")).alias("total_order_value"),
                    last.alias("last_order_date"), status.alias("customer_status"))


def count_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                   name: str = "child_count") -> DataFrame:
    """Correlated ``(SELECT COUNT(*) …)`` per parent row, 0 when none."""
    per = children.groupBy(F.col(child_key).alias("_pk")).agg(F.count(F.lit(1)).alias("_n"))
    j = parents.join(per, parents[parent_key] == per["_pk"], "left")
    return j.select(*[parents[c] for c in parents.columns], F.coalesce("_n", F.lit(0)).alias(name))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys with no parent, with the number of child rows for each."""
    miss = child.join(parent.select(F.col(parent_key).alias("_pk")).distinct(),
                      F.col(child_key) == F.col("_pk"), "left_anti")
    return miss.groupBy(child_key).agg(F.count(F.lit(1)).alias("orphan_rows"))


def dedupe_dimension(dim: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep one dimension row per key, the first in a declared order (the reference's
    UPDATE picks an arbitrary one)."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return dim.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def default_on_write(df: DataFrame, id_col: str, id_parts: Sequence[str], month_col: str,
                     date_col: str, language: str = "es") -> DataFrame:
    """ID ← own value unless blank, else CONCAT of parts; month ← own value unless blank,
    else the upper month name of the date; date ← TRY_CAST to date."""
    d = F.col(date_col).try_cast("date")
    return df.withColumns({
        id_col: F.coalesce(C.blank_to_null(id_col), C.concat_skip_nulls(*id_parts)),
        month_col: F.coalesce(C.blank_to_null(month_col), C.month_name_upper(d, language)),
        date_col: d,
    })


def enrich_month(df: DataFrame, dim: DataFrame, account_col: str, date_col: str,
                 dim_account: str, dim_year: str, dim_month: str, dim_name: str,
                 out_name: str, roll_year: bool = False) -> DataFrame:
    """Left join on account, year(date) and month(date) − 1 (January gives month 0 and never
    matches unless ``roll_year``). The dimension grows with accounts × months, so the join
    is left to AQE, which broadcasts it only after measuring it."""
    d = F.col(date_col)
    if roll_year:
        prev = F.add_months(d, -1)
        y, m = F.year(prev), F.month(prev)
    else:
        y, m = F.year(d), F.month(d) - 1
    keyed = df.withColumn("_y", y).withColumn("_m", m)
    small = dim.select(F.col(dim_account).alias("_a"), F.col(dim_year).alias("_dy"),
                       F.col(dim_month).alias("_dm"), F.col(dim_name).alias(out_name))
    cond = (keyed[account_col] == small["_a"]) & (keyed["_y"] == small["_dy"]) & (keyed["_m"] == small["_dm"])
    return keyed.join(small, cond, "left").drop("_y", "_m", "_a", "_dy", "_dm")


def check_pair(a, b) -> Column:
    """CORRECTO when both values are non-blank and equal, else INCORRECTO."""
    ca, cb = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    ok = C.blank_to_null(ca).isNotNull() & C.blank_to_null(cb).isNotNull() & (ca == cb)
    return F.when(ok, F.lit("CORRECTO")).otherwise(F.lit("INCORRECTO"))


def reconciliation_checks(df: DataFrame, pairs: dict[str, tuple[str, str]],
                          overall: str = "val_check") -> DataFrame:
    """One check column per pair plus the overall verdict.

    ``<overall>`` is computed from the fresh checks (VALIDADO when all are
    CORRECTO). ``<overall>_lagged`` mirrors the trigger, whose SET reads the
    check columns of the row before the update: on a fresh insert those are
    empty, so it is INVALIDO until the next update.
    """
    out = df.withColumns({name: check_pair(a, b) for name, (a, b) in pairs.items()})
    all_ok = None
    for name in pairs:
        x = F.col(name) == "CORRECTO"
        all_ok = x if all_ok is None else all_ok & x
    return out.withColumns({overall: F.when(all_ok, "VALIDADO").otherwise("INVALIDO"),
                            f"{overall}_lagged": F.lit("INVALIDO")})


def update_from(rows: DataFrame, sets: dict[str, Column],
                joins: Sequence[tuple[str, DataFrame, Sequence[tuple[Column, str]], Sequence[str]]] = ()) -> DataFrame:
    """``UPDATE ... SET ... FROM`` with left joins: every SET expression reads the old image of the row.

    Each join is (alias, table, [(row expression, table column)], order): its columns are read as ``alias.column``. Of
    several matches the first by ``order`` is taken (a database takes any one); a row without a match reads nulls. Rows
    are neither lost nor multiplied. A set name that the rows lack becomes a new column.
    """
    out = rows
    for alias, dim, on, order in joins:
        one = dedupe_dimension(dim, [c for _, c in on], order)
        packed = one.select(F.struct("*").alias(alias), *[F.col(c).alias(f"_{alias}_{i}") for i, (_, c) in enumerate(on)])
        cond = None
        for i, (expr, _) in enumerate(on):
            same = expr == F.col(f"_{alias}_{i}")
            cond = same if cond is None else cond & same
        out = out.join(packed, cond, "left").drop(*[f"_{alias}_{i}" for i in range(len(on))])
    return out.withColumns(sets).drop(*[alias for alias, *_ in joins])


def reconciliation_update(rows: DataFrame, pairs: dict[str, tuple[str, str]], codes: DataFrame, accounts: DataFrame, code: str,
                          account: str, date: str, captured: dict[str, str], overall: str = "val_check") -> DataFrame:
    """P16 with J5, as the write trigger does both in one UPDATE: checks per pair; the overall verdict from the OLD check
    columns (so it lags one update behind); captured values copied from the row; the concept by a code join; the
    account name by account, year and month - 1.

    ``codes`` has code and name, ``accounts`` account, year, month and name; of several the first name counts. Rows
    without check columns are fresh inserts: the old checks are null and the verdict is INVALIDO.
    """
    fresh = rows.withColumns({c: F.lit(None).cast("string") for c in (*pairs, overall) if c not in rows.columns})
    all_ok = None
    for c in pairs:
        ok = F.col(c) == "CORRECTO"
        all_ok = ok if all_ok is None else all_ok & ok
    d = F.col(date)
    return update_from(fresh, {
        **{c: check_pair(a, b) for c, (a, b) in pairs.items()},
        overall: F.when(all_ok, "VALIDADO").otherwise("INVALIDO"),
        **{out: F.col(src) for out, src in captured.items()},
        "concept": F.col("codes.name"), "account_name": F.col("accounts.name"),
    }, [("codes", codes, [(F.col(code), "code")], ["name"]),
        ("accounts", accounts, [(F.col(account), "account"), (F.year(d), "year"), (F.month(d) - 1, "month")], ["name"])])


#: Rows of a list that a task of the distinct join takes, about.
PACKAGE_ROWS = 200_000


def matched_payments(captures: DataFrame, budget: DataFrame) -> DataFrame:
    """J4 as the reconciliation load does it: captured payments joined to budget lines by their package, distinct.

    ``captures``: id_number, capture_id, account_no, collection_date, payer_name, value; ``budget``: invoice, third_id,
    third_name, value, code. The record id joins the payer's number and the package number (null parts and package
    texts that aren't numbers count as empty); the third party's name starts after its second dash. Rows without
    package match nothing. The package is among the distinct columns, so the join's partitioning serves both: it deals
    packages by the rows there are, as repeated texts pack so well that bytes say little of a task's memory.
    """
    p = captures.select("id_number", "capture_id", "account_no", "collection_date", "payer_name", F.col("value").alias("movement_value"))
    b = budget.select("invoice", "third_id", "third_name", F.col("value").alias("captured_value"), "code")
    # with fewer parts than a shuffle has by default, Spark would deal the rows once more
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(p.count(), b.count()) // PACKAGE_ROWS))
    p, b = p.repartition(tasks, "capture_id"), b.repartition(tasks, "invoice")
    return p.join(b, p["capture_id"] == b["invoice"]).select(
        C.concat_skip_nulls("id_number", F.col("capture_id").try_cast("bigint")).alias("id"), F.lit("").alias("month"),
        "account_no", "collection_date", F.col("id_number").alias("nit_payer"), "payer_name", "movement_value",
        F.col("third_id").alias("nit_beneficiary"), C.after_second_dash(F.col("third_name")).alias("third_name"), "captured_value",
        "code", F.col("capture_id").alias("package_id_captured"), F.col("invoice").alias("package_id")).distinct()


def reconciliation_load(captures: DataFrame, budget: DataFrame, codes: DataFrame, accounts: DataFrame,
                        pairs: dict[str, tuple[str, str]], captured: dict[str, str], language: str = "es") -> DataFrame:
    """E4 whole: distinct join (J4), defaults on write (P12), then the write trigger's update (P16 with J5's joins)."""
    rows = default_on_write(matched_payments(captures, budget), "id", ["nit_payer", "package_id"], "month", "collection_date", language)
    return reconciliation_update(rows, pairs, codes, accounts, "code", "account_no", "collection_date", captured)


def dimension_chain(rows: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[tuple[str, str]], dict[str, str]]],
                    depth: str = "levels_matched") -> DataFrame:
    """Left joins of ``rows`` to one dimension after another, each on several columns.

    A level is (dimension, [(column so far, dimension column)], {dimension column: name}); its key columns are dropped.
    A row without a match reads nulls, so it matches no later level that is keyed on them; ``depth`` counts the levels it
    matched. Several matches multiply a row, as in SQL; null keys match nothing.
    """
    out, hits = rows, []
    for i, (dim, on, keep) in enumerate(levels):
        keys = [f"_k{i}_{j}" for j in range(len(on))]
        side = dim.select(*[F.col(c).alias(k) for (_, c), k in zip(on, keys)], *[F.col(c).alias(n) for c, n in keep.items()],
                          F.lit(1).alias(f"_hit{i}"))
        cond = F.lit(True)
        for (c, _), k in zip(on, keys):
            cond = cond & (F.col(c) == F.col(k))
        out = out.join(side, cond, "left").drop(*keys)
        hits.append(f"_hit{i}")
    total = F.lit(0)
    for h in hits:
        total = total + F.coalesce(F.col(h), F.lit(0))
    return out.withColumn(depth, total).drop(*hits)


def mentioned(rows: DataFrame, name: str, text: str) -> DataFrame:
    """J6's filter: rows whose ``text`` contains the upper-cased ``name``; null and empty names are nowhere."""
    return rows.filter((F.col(name) != "") & (F.instr(F.col(text), F.upper(name)) > 0))


def phase_durations(events: DataFrame, user: str, ts: str) -> DataFrame:
    """Per user and day, the phase start/end and its duration in milliseconds."""
    per = events.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("records"))
    return per.withColumn("duration_ms", C.duration_ms("start_time", "end_time"))


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: str, hours: int = 24,
                    user_key: str = "user_id", users_key: str = "c_custkey") -> DataFrame:
    """Active sessions started within ``hours`` before ``as_of``, joined to their user."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    s = sessions.filter(F.col("is_active") & (F.col("login_time") >= ts - F.expr(f"INTERVAL {hours} HOURS"))
                        & (F.col("login_time") <= ts))
    return s.join(users, s[user_key] == users[users_key], "inner")


def lookup_default(df: DataFrame, lookup: DataFrame, df_col: str, lookup_col: str, value_col: str,
                   out: str, default=0) -> DataFrame:
    """Value looked up by name, ``default`` when absent (lookup deduplicated on its key)."""
    lk = lookup.groupBy(F.col(lookup_col).alias("_lk")).agg(F.min(value_col).alias("_lv"))
    j = df.join(lk, df[df_col] == lk["_lk"], "left")
    return j.select(*[df[c] for c in df.columns], F.coalesce("_lv", F.lit(default)).alias(out))


def source_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per source, row count, column count and whether it has data."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("source_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            (F.col("row_count") > 0).alias("has_data"))
        out = one if out is None else out.unionByName(one)
    return out
