"""Scalar ``Column`` builders: casts, text helpers, pattern tests, decoding.

All of them are built-in expressions, so they stay inside whole-stage codegen.
ANSI mode is on in Spark 4, so every parse goes through a ``try_*`` function.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_list(values: Iterable[str]) -> list[Column]:
    return [F.lit(v) for v in values]


# -- F1 / F2 / F3 / F4 -------------------------------------------------------

def blank_to_null(col) -> Column:
    """``CASE WHEN LEN(x)=0 THEN NULL ELSE x END``: length ignores trailing blanks."""
    c = _c(col)
    return F.when(F.rtrim(c) == "", F.lit(None)).otherwise(c)


def concat_skip_nulls(*cols) -> Column:
    """CONCAT that treats nulls as empty text."""
    return F.concat_ws("", *[_c(c).cast("string") for c in cols])


def after_second_dash(col) -> Column:
    """Text after the second ``-``; the whole text when there are fewer than two."""
    return F.regexp_replace(_c(col), r"^[^-]*-[^-]*-", "")


def month_name_upper(col, language: str = "en") -> Column:
    """Upper-case month name of a date; English or Spanish."""
    c = _c(col)
    if language == "es":
        names = F.array(*_lit_list(K.SPANISH_MONTHS))
        return F.element_at(names, F.month(c))
    return F.upper(F.date_format(c, "MMMM"))


def to_uuid(col) -> Column:
    """F5's guard of session ids: a UUID in upper case, braces dropped; anything else null."""
    c = F.regexp_replace(_c(col).cast("string"), r"^\{(.*)\}$", "$1")
    return F.when(c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.upper(c))


# -- P5 .. P11: casts --------------------------------------------------------

#: Blanks that a text strip removes at both ends: Unicode white space and the ASCII separators.
_BLANK = r"[\s\x1c-\x1f]"
#: What counts as a number: decimal digits with an optional exponent, or inf/nan. The JVM's own suffixes
#: (``12d``, ``3F``) and hexadecimal floats are text.
NUMBER_TEXT = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"


def strip(col) -> Column:
    """Text without blanks of any kind (tabs, line breaks, no-break spaces, ...) at its ends."""
    return F.regexp_replace(_c(col).cast("string"), rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def parse_number(text: Column, dtype: str = "double") -> Column:
    """Cast of text that is a number under :data:`NUMBER_TEXT`, else null."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast(dtype))


def to_double(col) -> Column:
    """Coerce to a number; unparsable text becomes null."""
    return parse_number(strip(col))


def to_integer(col) -> Column:
    """Coerce to an integer per row: unparsable or fractional values become null (P5, row mode)."""
    d = to_double(col)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def any_fractional(col) -> Column:
    """Aggregate: does the column hold a non-integral number (P5 column mode decides on it)."""
    d = to_double(col)
    return F.coalesce(F.max(d != F.floor(d)), F.lit(False))


def to_timestamp_multi(col, formats: Sequence[str] = tuple(K.DATE_FORMATS)) -> Column:
    """First format that parses wins; none parses → null."""
    c = strip(col)
    # parse, then keep the wall-clock value (independent of the session time zone)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_boolean(col) -> Column:
    """Lower + trim; configured true/false words, anything else null."""
    v = F.lower(strip(col))
    return (F.when(v.isin(*K.BOOL_TRUE_WORDS), F.lit(True))
            .when(v.isin(*K.BOOL_FALSE_WORDS), F.lit(False)))


def normalize_text(col, null_tokens: bool = False) -> Column:
    """Stringify and strip; the text ``nan`` (or every null token) becomes null."""
    v = strip(col)
    if null_tokens:
        return F.when(F.lower(v).isin(*K.NULL_TOKENS), F.lit(None)).otherwise(v)
    return F.when(v == "nan", F.lit(None)).otherwise(v)


def parse_locale_number(col, decimal_mark: str = ",", group_mark: str = ".",
                        dtype: str = "decimal(19,4)") -> Column:
    """Locale money/number text such as ``$ 13.528.336,00`` → decimal."""
    v = F.regexp_replace(_c(col).cast("string"), r"[\$\s]", "")
    v = F.replace(v, F.lit(group_mark), F.lit(""))
    v = F.replace(v, F.lit(decimal_mark), F.lit("."))
    return v.try_cast(dtype)


# -- P14 / P15 ---------------------------------------------------------------

def decode(col, labels: Mapping[str, str]) -> Column:
    """Code → label with fallback to the code itself."""
    c = _c(col)
    expr = None
    for code, label in labels.items():
        expr = (F.when(c == code, F.lit(label)) if expr is None
                else expr.when(c == code, F.lit(label)))
    return c if expr is None else expr.otherwise(c)


PATTERNS = {
    "email": K.EMAIL_PATTERN,
    "phone": K.PHONE_PATTERN,
    "numeric": K.NUMERIC_PATTERN,
    "date": K.DATE_PATTERN,
}


def matches(col, kind: str) -> Column:
    """Anchored pattern test of a text value."""
    return _c(col).rlike(PATTERNS[kind])


def phone_digits(col) -> Column:
    """Keep digits and ``+`` only, as the phone check does before matching."""
    return F.regexp_replace(_c(col).cast("string"), r"[^\d+]", "")


# -- F8: name normalisation --------------------------------------------------

def normalize_name(col) -> Column:
    """lower, drop non ``[a-z0-9]``, strip one known prefix then one known suffix, never to empty."""
    v = F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9]", "")
    prefixes = "|".join(K.NAME_PREFIXES)
    suffixes = "|".join(K.NAME_SUFFIXES)
    v = F.regexp_replace(v, rf"^({prefixes})(?=.)", "")
    return F.regexp_replace(v, rf"(?<=.)({suffixes})$", "")


def clean_header(name: str, ordinal: int) -> str:
    """Source header cleaning: strip, drop ``[^\\w\\s-]``, collapse blanks; empty → ``Column_<n>``."""
    import re

    clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", "", str(name).strip()))
    return clean if clean else f"Column_{ordinal}"


# -- S7: RANGE RIGHT partition number ---------------------------------------

def range_right_partition(col, boundaries: Sequence[str]) -> Column:
    """1 + number of boundaries ≤ value (a boundary value belongs to the right)."""
    c = _c(col)
    hits = [F.when(c >= F.lit(b).cast("timestamp_ntz"), 1).otherwise(0) for b in boundaries]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return (F.lit(1) + total).cast("int")


# -- P13 ---------------------------------------------------------------------

def duration_ms(start, end) -> Column:
    """Milliseconds between two timestamps, as DATEDIFF(MILLISECOND, …) counts them."""
    return (F.unix_millis(_c(end).cast("timestamp")) - F.unix_millis(_c(start).cast("timestamp")))
