from pyspark.sql import functions as F

from gridload.functions import columns as C
from gridload.operators import typing_ops as TY


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_integer_row_and_column_mode(spark):
    assert one(spark, C.to_integer("v"), "12") == 12
    assert one(spark, C.to_integer("v"), "12.5") is None
    assert one(spark, C.to_integer("v"), "abc") is None
    df = spark.createDataFrame([("1",), ("2.5",)], "v string")
    assert [r.v for r in TY.cast_columns(df, {"v": "int"}, "column").collect()] == ["1", "2.5"]
    assert [r.v for r in TY.cast_columns(df, {"v": "int"}, "row").collect()] == [1, None]


def test_boolean_words(spark):
    assert one(spark, C.to_boolean("v"), " Sí ") is True
    assert one(spark, C.to_boolean("v"), "falso") is False
    assert one(spark, C.to_boolean("v"), "y") is None


def test_text_and_null_tokens(spark):
    assert one(spark, C.normalize_text("v"), " nan ") is None
    assert one(spark, C.normalize_text("v"), " N/A ") == "N/A"
    assert one(spark, C.normalize_text("v", null_tokens=True), " N/A ") is None


def test_locale_money(spark):
    from decimal import Decimal

    assert one(spark, C.parse_locale_number("v"), "$ 13.528.336,00") == Decimal("13528336.0000")
    assert one(spark, C.parse_locale_number("v"), "139820,63") == Decimal("139820.6300")


def test_dates_first_format_wins(spark):
    import datetime as dt

    assert one(spark, C.to_timestamp_multi("v"), "05/12/1998") == dt.datetime(1998, 12, 5)
    assert one(spark, C.to_timestamp_multi("v"), "1998-12-05") == dt.datetime(1998, 12, 5)
    assert one(spark, C.to_timestamp_multi("v"), "junk") is None


def test_name_normalisation(spark):
    assert one(spark, C.normalize_name("v"), "tbl_Customer_ID") == "customer"
    assert one(spark, C.normalize_name("v"), "id") == "id"          # never to empty
    assert one(spark, C.normalize_name("v"), "colno") == "no"       # prefix first, then no suffix left
    assert one(spark, C.normalize_name("v"), "Código") == "cdigo"   # accented letters dropped


def test_blank_concat_and_dash(spark):
    assert one(spark, C.blank_to_null("v"), "   ") is None
    assert one(spark, C.blank_to_null("v"), " a ") == " a "
    assert one(spark, C.after_second_dash("v"), "1-2-rest-x") == "rest-x"
    assert one(spark, C.after_second_dash("v"), "only-one") == "only-one"
    assert one(spark, C.concat_skip_nulls(F.col("v"), F.lit(None)), "a") == "a"


def test_clean_header():
    assert C.clean_header("  Company   Name ", 0) == "Company Name"
    assert C.clean_header("Acct Bal ($)", 0) == "Acct Bal "
    assert C.clean_header("$$$", 7) == "Column_7"


def test_range_right_partition(spark):
    b = ["2025-01-01", "2025-02-01"]
    expr = C.range_right_partition(F.col("v").cast("timestamp_ntz"), b)
    assert one(spark, expr, "2024-12-31") == 1
    assert one(spark, expr, "2025-01-01") == 2   # boundary goes right
    assert one(spark, expr, "2025-03-01") == 3


def test_type_vote_ties_and_threshold(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), ("1,000",), ("2024-01-02",)], "v string")
    r = TY.type_vote(df).first()
    assert r.n_boolean == 1 and r.n_integer == 2 and r.detected_type == "STRING"


def test_numbers_and_blanks(spark):
    rows = [("12d",), ("3F",), ("0x1p3",), (" 1e3\t",), ("\u00a0-.5\n",), ("inf",), ("1_0",), ("",), ("+7.",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(C.to_double("s")).collect()]
    assert got == [None, None, None, 1000.0, -0.5, float("inf"), None, None, 7.0]
    rows = [("yes\n",), ("\tnan",), ("\t",), ("\u2003x y\x1f",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(C.to_boolean("s")).collect()] == [True, None, None, None]
    assert [r[0] for r in df.select(C.normalize_text("s")).collect()] == ["yes", None, "", "x y"]
    assert [r[0] for r in df.select(C.normalize_text("s", null_tokens=True)).collect()] == ["yes", None, None, "x y"]
