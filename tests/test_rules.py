from pyspark.sql import functions as F

from gridload.operators import rules as R


def test_rules_in_one_issue_table(spark):
    df = spark.createDataFrame(
        [(1, "ok@mail.com", "-5", "a;b", "2024-01-01"), (2, "bad", "3", "fine", "1800-01-01"),
         (3, None, "x", None, "2099-01-01")],
        "id int, email string, total_amount string, note string, when_ string")
    specs = [R.ColumnSpec("email", "email", "STRING", max_length=5, nullable=False),
             R.ColumnSpec("total_amount", "total", "DECIMAL"),
             R.ColumnSpec("note", "note", "STRING"),
             R.ColumnSpec("when_", "when_", "DATE"),
             R.ColumnSpec("missing", "missing", "STRING")]
    issues = R.validate(df, specs, F.col("id") + 1, as_of="2080-01-01 00:00:00").collect()
    got = {(i.row_number, i.column_name, i.rule_name) for i in issues}
    assert (2, "email", "string_length") in got            # 11 chars > 5
    assert (3, "email", "email_format") in got               # 'bad'
    assert (4, "email", "required_value") in got             # null, not nullable
    assert (2, "total_amount", "positive_number") in got
    assert (4, "total_amount", "data_type_validation") in got
    assert (2, "note", "special_characters") in got
    assert (3, "when_", "date_range") in got
    assert (4, "when_", "date_range") in got                 # > as_of + 10 years
    assert (0, "missing", "missing_column") in got
    assert (0, "id", "extra_column") in got


def test_verdict_counts_issues_not_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    issues = spark.createDataFrame([(2, "a", "", "r", "m", "ERROR", None)] * 3, R.ISSUE_SCHEMA)
    v = R.verdict(issues, df).first()
    assert (v.error_count, v.valid_rows, v.rows_without_errors, v.is_valid) == (3, -1, 1, False)


def test_registry_add_remove():
    reg = R.default_registry()
    reg.remove_rule("special_characters")
    assert "special_characters" not in reg.rules
    reg.add_rule(R.Rule("custom", "INFO", lambda c, ctx: (c.isNull(), F.lit("x"))))
    assert "custom" in reg.rules


def test_required_targets_without_mapping(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    specs = [R.ColumnSpec("name", "name", "STRING")]
    issues = R.validate(df, specs, F.col("id") + 1, structure=False,
                        required_targets=["name", "code"]).collect()
    assert [(i.row_number, i.column_name, i.rule_name, i.severity) for i in issues] == \
        [(0, "code", "missing_required_column", "ERROR")]


def test_strict_null_error_option(spark):
    from gridload.operators import profile as PR

    df = spark.createDataFrame([(None,)] * 9 + [("x",)], "v string")
    r = PR.column_profile(df, strict_null_error=True).first()
    assert r.null_warning and r.null_error
