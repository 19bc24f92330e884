"""Row validation: a rule registry evaluated in one scan into an issues DataFrame.

Issue layout: ``row_number, column_name, value, rule_name, message, severity,
suggested_fix``. Every per-value rule is a ``Column`` predicate; for each
row all (column, rule) hits are packed into one ``array`` of structs and
exploded, so the sheet is read once whatever the number of rules.
Uniqueness rules need counts per value and come from an aggregate joined
back; structure rules come from the schema alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from . import dedup as D

ISSUE_SCHEMA = ("row_number bigint, column_name string, value string, rule_name string, "
                "message string, severity string, suggested_fix string")
ALL_TYPES = ("STRING", "INTEGER", "DECIMAL", "BOOLEAN", "DATE", "DATETIME")


@dataclass
class ColumnSpec:
    """How one source column maps to the target (the mapping argument of the load)."""
    source: str
    target: str | None = None
    data_type: str = "STRING"
    max_length: int | None = None
    nullable: bool = True


@dataclass
class RuleContext:
    spec: ColumnSpec
    as_of: str


@dataclass
class Rule:
    """A named check: ``check(col, ctx)`` returns ``(bad, message)`` Columns, or None when it
    does not apply to that column."""
    name: str
    severity: str
    check: Callable[[Column, RuleContext], tuple[Column, Column] | None]
    types: tuple[str, ...] = ALL_TYPES
    suggested_fix: str | None = None


@dataclass
class RuleRegistry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def add_rule(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def remove_rule(self, name: str) -> None:
        self.rules.pop(name, None)


# -- default business rules (V1-V6) ---------------------------------------------

def _required(c: Column, ctx: RuleContext):
    if ctx.spec.nullable:
        return None
    return c.isNull() | (C.strip(c) == ""), F.lit("Required field cannot be empty")


def _string_length(c: Column, ctx: RuleContext):
    n = ctx.spec.max_length
    if n is None:
        return None
    return (F.char_length(c.cast("string")) > n,
            F.lit(f"Length exceeds the maximum allowed ({n} characters)"))


def _email_format(c: Column, ctx: RuleContext):
    name = ctx.spec.source.lower()
    if "email" not in name and "mail" not in name:
        return None
    return ~c.cast("string").rlike(K.EMAIL_PATTERN), F.lit("Invalid email format")


def _positive_number(c: Column, ctx: RuleContext):
    name = ctx.spec.source.lower()
    if not any(w in name for w in K.POSITIVE_NAME_WORDS):
        return None
    return C.to_double(c) < 0, F.lit("Value should be positive")


def _date_range(c: Column, ctx: RuleContext):
    ts = F.coalesce(c.try_cast("timestamp_ntz"), C.to_timestamp_multi(c).cast("timestamp_ntz"))
    lo = F.lit(K.DATE_RANGE_MIN).cast("timestamp_ntz")
    hi = F.lit(K.DATE_RANGE_MAX).cast("timestamp_ntz")
    horizon = F.lit(ctx.as_of).cast("timestamp_ntz") + F.expr(f"INTERVAL {K.FUTURE_YEARS} YEARS")
    out_of_range = (ts < lo) | (ts > hi)
    bad = out_of_range | (ts > horizon)
    msg = F.when(out_of_range, F.lit("Date outside the valid range (1900-2100)")) \
        .otherwise(F.lit("Date too far in the future"))
    return bad, msg


def _special_characters(c: Column, ctx: RuleContext):
    s = c.cast("string")
    first = None
    for ch in K.SPECIAL_CHARS:
        first = F.when(s.contains(ch), F.lit(ch)) if first is None else first.when(s.contains(ch), F.lit(ch))
    return first.isNotNull(), F.concat(F.lit("Contains potentially problematic characters: "), first)


def default_registry() -> RuleRegistry:
    reg = RuleRegistry()
    reg.add_rule(Rule("required_value", "ERROR", _required))
    reg.add_rule(Rule("string_length", "ERROR", _string_length, ("STRING",)))
    reg.add_rule(Rule("email_format", "WARNING", _email_format, ("STRING",)))
    reg.add_rule(Rule("positive_number", "WARNING", _positive_number, ("INTEGER", "DECIMAL")))
    reg.add_rule(Rule("date_range", "WARNING", _date_range, ("DATE", "DATETIME")))
    reg.add_rule(Rule("special_characters", "INFO", _special_characters, ("STRING",)))
    return reg


# -- V8: cell type check ----------------------------------------------------------

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def type_check(c: Column, data_type: str, spark_type: str):
    """``(bad, message)`` for a value that is not of the mapped logical type; None for STRING."""
    is_num = spark_type in _NUMERIC or spark_type.startswith("decimal")
    text = c.cast("string")
    if data_type == "INTEGER":
        if spark_type in _NUMERIC[:4]:
            return None
        if is_num:
            return c != F.floor(c), F.lit("Not a valid integer")
        return C.parse_number(F.replace(C.strip(text), F.lit(","), F.lit("")), "bigint").isNull(), \
            F.lit("Not a valid integer")
    if data_type == "DECIMAL":
        if is_num:
            return None
        return C.parse_number(F.replace(C.strip(text), F.lit(","), F.lit(""))).isNull(), \
            F.lit("Not a valid decimal number")
    if data_type == "BOOLEAN":
        if spark_type == "boolean":
            return None
        return ~F.lower(C.strip(text)).isin(*K.BOOL_CHECK_WORDS), F.lit("Not a valid boolean value")
    if data_type in ("DATE", "DATETIME"):
        if spark_type.startswith("timestamp") or spark_type == "date" or is_num:
            return None
        return C.to_timestamp_multi(text).isNull(), F.lit("Not a valid date/time")
    return None


# -- the validator -----------------------------------------------------------------

def _issue(row_no: Column, column: str, value: Column, rule: str, message: Column, severity: str,
           fix: str | None) -> Column:
    return F.struct(row_no.cast("bigint").alias("row_number"), F.lit(column).alias("column_name"),
                    value.cast("string").alias("value"), F.lit(rule).alias("rule_name"),
                    message.alias("message"), F.lit(severity).alias("severity"),
                    F.lit(fix).cast("string").alias("suggested_fix"))


def validate(df: DataFrame, mappings: Sequence[ColumnSpec], row_number: Column,
             constraints: dict | None = None, registry: RuleRegistry | None = None,
             as_of: str = "2025-01-01 00:00:00", structure: bool = True,
             required_targets: Sequence[str] = ()) -> DataFrame:
    """E3 issues: structure (V12), cell types (V8), constraints (V9, V10), business rules (V1-V6)
    and possible duplicates (V11), as one issues DataFrame.

    ``row_number`` is the sheet row of each record (e.g. position + 2).
    ``required_targets`` are target columns that are NOT NULL without a default: each one no
    mapping feeds becomes a row-0 ERROR issue.
    """
    registry = registry or default_registry()
    constraints = constraints or {}
    dtypes = dict(df.dtypes)
    present = [m for m in mappings if m.source in df.columns]
    spark = df.sparkSession

    checks = []
    for m in present:
        c = F.col(m.source)
        tc = type_check(c, m.data_type, dtypes[m.source])
        if tc is not None:
            bad, msg = tc
            checks.append(F.when(c.isNotNull() & bad,
                                 _issue(row_number, m.source, c, "data_type_validation", msg, "ERROR",
                                        f"Convert to type {m.data_type}")))
        if m.target and m.target in constraints.get("not_null_columns", []):
            checks.append(F.when(c.isNull(), _issue(row_number, m.source, F.lit("NULL"),
                                                    "not_null_constraint",
                                                    F.lit(f"Column '{m.target}' cannot be null"),
                                                    "ERROR", "Provide a valid value")))
        ctx = RuleContext(m, as_of)
        for rule in registry.rules.values():
            if m.data_type not in rule.types:
                continue
            res = rule.check(c, ctx)
            if res is None:
                continue
            bad, msg = res
            guard = bad if rule.name == "required_value" else (c.isNotNull() & bad)
            checks.append(F.when(guard, _issue(row_number, m.source, c, rule.name, msg, rule.severity,
                                               rule.suggested_fix)))
    parts = []
    if checks:
        hits = F.filter(F.array(*checks), lambda x: x.isNotNull())
        parts.append(df.select(F.explode(hits).alias("i")).select("i.*"))

    # V10 unique constraint and V11 possible duplicates: every row of a repeated value, all columns in one pass
    specs = []
    for m in present:
        if m.target and m.target in constraints.get("unique_columns", []):
            specs.append((m.source, "unique_constraint", f"Duplicate value in unique column '{m.target}'", "ERROR",
                          "Ensure unique values"))
        if any(w in m.source.lower() for w in K.UNIQUE_NAME_WORDS):
            specs.append((m.source, "potential_duplicate", f"Possible duplicate value in column '{m.source}'",
                          "WARNING", "Check whether duplicates are intended"))
    if specs:
        unique = list(dict.fromkeys(x[0] for x in specs))
        cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(unique)])
        long = df.select(row_number.cast("bigint").alias("row_no"), F.explode(cells).alias("cell")).select("row_no", "cell.*")
        members = D.duplicate_members(long, ["column", "value"])
        found = [F.when(F.col("column") == unique.index(source),
                        _issue(F.col("row_no"), source, F.col("value"), rule, F.lit(msg), sev, fix))
                 for source, rule, msg, sev, fix in specs]
        parts.append(members.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("i.*"))

    rows = []
    if structure:
        expected = [m.source for m in mappings]
        rows += [(0, c, "", "missing_column", f"Expected column '{c}' not found", "ERROR",
                  "Check the sheet's column names") for c in expected if c not in df.columns]
        rows += [(0, c, "", "extra_column", f"Unexpected column '{c}' found", "INFO",
                  "Consider adding it to the mapping") for c in df.columns if c not in expected]
    mapped_targets = {m.target for m in mappings if m.target}
    rows += [(0, t, "", "missing_required_column", f"Required target column '{t}' has no mapping",
              "ERROR", "Map a source column or give the column a default")
             for t in required_targets if t not in mapped_targets]
    if rows:
        parts.append(spark.createDataFrame(rows, ISSUE_SCHEMA))
    if not parts:
        return spark.createDataFrame([], ISSUE_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdict(issues: DataFrame, rows: DataFrame, max_error_rate: float = K.MAX_ERROR_RATE) -> DataFrame:
    """error/warning counts, error rate, validity and valid rows of a validated batch.

    ``rows`` is the validated DataFrame (only counted). ``valid_rows`` counts
    issues like the reference does (rows − errors, may go negative);
    ``rows_without_errors`` counts rows that have no ERROR issue.
    """
    # one pass over the issues: counts per row, then summed together with the rows themselves
    levels = {"error_count": "ERROR", "warning_count": "WARNING", "info_count": "INFO", "critical_count": "CRITICAL"}
    per_row = issues.groupBy("row_number").agg(*[F.count_if(F.col("severity") == v).alias(k) for k, v in levels.items()])
    hit = ((F.col("error_count") > 0) & (F.col("row_number") > 0)).cast("bigint")
    tagged = (per_row.select(F.lit(0).cast("bigint").alias("processed_rows"), *levels, hit.alias("rows_with_errors"))
              .unionByName(rows.select(F.lit(1).cast("bigint").alias("processed_rows"),
                                       *[F.lit(0).cast("bigint").alias(k) for k in (*levels, "rows_with_errors")])))
    both = tagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in tagged.columns])
    rate = F.when(F.col("processed_rows") > 0, F.col("error_count") / F.col("processed_rows")).otherwise(0.0)
    return both.select(
        "processed_rows", "error_count", "warning_count", "info_count", "critical_count",
        F.round(rate, 6).alias("error_rate"),
        (rate <= max_error_rate).alias("is_valid"),
        (F.col("processed_rows") - F.col("error_count")).alias("valid_rows"),
        (F.col("processed_rows") - F.col("rows_with_errors")).alias("rows_without_errors"),
        (rate > max_error_rate).alias("high_error_rate_warning"))


def top_issues(issues: DataFrame, limits: dict[str, int] | None = None, default: int = K.TOP_ERRORS) -> DataFrame:
    """The first k issues per severity by row, column, rule (10 errors, 5 warnings by default).

    ``row_number() <= k`` gets a partial group limit before the shuffle.
    """
    limits = limits or {"ERROR": K.TOP_ERRORS, "WARNING": K.TOP_WARNINGS}
    k = F.lit(default)
    for sev, n in limits.items():
        k = F.when(F.col("severity") == sev, F.lit(n)).otherwise(k)
    w = Window.partitionBy("severity").orderBy("row_number", "column_name", "rule_name", "message", "value")
    kmax = max([default] + list(limits.values()))
    return (issues.withColumn("issue_rank", F.row_number().over(w).cast("bigint")).filter(F.col("issue_rank") <= kmax)
            .filter(F.col("issue_rank") <= k))


def mapping_check(df: DataFrame, mappings: Sequence[ColumnSpec], not_null_targets: Sequence[str] = ()) -> DataFrame:
    """Per mapped column, over the whole column: all-null warning, nulls flowing into a
    NOT NULL target, values not of the mapped type (V8) and values over the length (V2);
    ``compatible`` when none of the errors occur. One aggregate for all columns."""
    dtypes = dict(df.dtypes)
    present = [m for m in mappings if m.source in df.columns]
    aggs, names = [], []
    for i, m in enumerate(present):
        c = F.col(m.source)
        tc = type_check(c, m.data_type, dtypes[m.source])
        type_bad = (c.isNotNull() & tc[0]) if tc is not None else F.lit(False)
        long_bad = (F.char_length(c.cast("string")) > m.max_length) if m.max_length else F.lit(False)
        aggs += [F.count(c).alias(f"nn{i}"), F.count_if(type_bad).alias(f"tb{i}"),
                 F.count_if(F.coalesce(long_bad, F.lit(False))).alias(f"lb{i}")]
        names.append(m)
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    parts = []
    for i, m in enumerate(names):
        nulls = F.col("n") - F.col(f"nn{i}")
        into_nn = nulls if (m.target in not_null_targets or not m.nullable) else F.lit(0).cast("bigint")
        parts.append(row.select(
            F.lit(m.source).alias("column_name"), F.lit(m.target).alias("target_column"),
            F.lit(m.data_type).alias("data_type"), F.col("n").alias("n_rows"), nulls.alias("n_null"),
            (F.col(f"nn{i}") == 0).alias("all_null_warning"), into_nn.alias("null_into_not_null"),
            F.col(f"tb{i}").alias("type_errors"), F.col(f"lb{i}").alias("length_errors"),
            ((into_nn == 0) & (F.col(f"tb{i}") == 0) & (F.col(f"lb{i}") == 0)).alias("compatible")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
