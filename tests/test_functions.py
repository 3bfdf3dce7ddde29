"""Column expressions on small frames that hold every missing-value edge."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohort_engine.functions import dates as D, missing as M, scalars as S, text as X
from conftest import rows


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) or v is None else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


INF = float("inf")


@pytest.mark.parametrize("a", [None, 3, 5])
@pytest.mark.parametrize("b", [None, 3, 5])
def test_missing_is_above_every_number(spark, a, b):
    x, y = (INF if v is None else v for v in (a, b))
    df = spark.createDataFrame([(a, b)], "a int, b int")
    for other in (F.col("b"), b):  # a column and a literal
        got = df.select(M.gt("a", other), M.ge("a", other), M.lt("a", other), M.le("a", other), M.eq("a", other), M.ne("a", other)).first()
        assert tuple(got) == (x > y, x >= y, x < y, x <= y, x == y, x != y)


def test_comparison_with_literal_is_pushed(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(M.ge("id", 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(id),GreaterThanOrEqual(id,5))" in plan


def test_flags(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "a int")
    assert rows(df.select(M.as_flag(F.col("a") == 1))) == [(0,), (0,), (1,)]
    assert rows(df.select(S.range_flag("a", 2, 3), S.member_flag("a", [1]))) == [(0, 0), (0, 1), (1, 0)]
    assert rows(df.select(S.row_total("a", "a"), S.row_sum("a", "a"))) == [(0, None), (2, 2), (4, 4)]


@pytest.mark.parametrize("text,expected", [
    ("12", 12.0), (" 12.50 ", 12.5), ("-3", -3.0), ("1e3", 1000.0), (".5", 0.5), ("12d", None), ("12/3", None), ("", None),
    (".", None), (None, None), ("1 2", None), ("NaN", None), ("0x10", None)])
def test_forced_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(X.to_number("a")).first()[0] == expected


def test_strict_number_fails(spark):
    df = spark.createDataFrame([("7",), ("x7",)], "a string")
    with pytest.raises(Exception, match="not a number"):
        df.select(X.to_number("a", force=False)).collect()
    assert df.limit(1).select(X.to_number("a", force=False, kind="int")).first()[0] == 7


def test_keys_and_words(spark):
    df = spark.createDataFrame([("12-ab-3",), ("solo",), (None,)], "k string")
    assert rows(df.select(X.split_key("k", 1), X.split_key("k", 2))) == [(None, None), ("12", "ab"), ("solo", None)]
    df = spark.createDataFrame([("Program  Referred",), (" one ",), ("",), (None,)], "s string")
    got = df.select(X.nth_word("s", 2), X.word_count("s")).collect()
    assert [tuple(r) for r in got] == [("Referred", 2), (None, 1), (None, 0), (None, 0)]


def test_codes_markers_recode(spark):
    df = spark.createDataFrame([("5043/1/99",), (" 23 ",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(X.code_list("c")).collect()] == [["5043", "1", "99"], ["23"], [None], [None]]
    df = spark.createDataFrame([("NULL",), ("Unknown ",), ("3001",), (None,)], "c string")
    assert [r[0] for r in df.select(X.null_marker("c")).collect()] == [None, None, "3001", None]
    df = spark.createDataFrame([("1B",), ("1C",), ("2",), (None,)], "c string")
    assert [r[0] for r in df.select(X.recode("c", {"1B": "1", "1C": "1"})).collect()] == ["1", "1", "2", None]


def test_date_parsers(spark):
    def parsed(expr, text):
        return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]

    day = dt.date(1965, 11, 5)
    assert parsed(D.parse_date("t"), "05nov1965 00:00:00") == day
    assert parsed(D.parse_date_dmy("t"), "5/11/1965") == day
    assert parsed(D.parse_date_dmy("t"), "05-11-1965") == day
    assert parsed(D.parse_date_prefix("t"), "1965-11-05T10:00") == day
    assert parsed(D.parse_datetime("t"), "1965-11-05 10:20:30") == dt.datetime(1965, 11, 5, 10, 20, 30)
    assert parsed(D.parse_datetime("t"), "1965-11-05 10:20:30.123") == dt.datetime(1965, 11, 5, 10, 20, 30, 123000)
    for expr in (D.parse_date("t"), D.parse_date_dmy("t"), D.parse_date_prefix("t"), D.parse_datetime("t")):
        assert parsed(expr, "no date") is None and parsed(expr, None) is None


@pytest.mark.parametrize("day,month,quarter", [
    (dt.date(1960, 1, 1), 0, 0), (dt.date(1959, 12, 31), -1, -1), (dt.date(2022, 3, 31), 746, 248), (dt.date(2025, 9, 1), 788, 262)])
def test_period_numbers(spark, day, month, quarter):
    df = spark.createDataFrame([(day,)], "d date")
    m, q, q2, back = df.select(D.month_index("d"), D.quarter_index("d"), D.quarter_of_month(D.month_index("d")), D.month_start(D.month_index("d"))).first()
    assert (m, q, q2) == (month, quarter, quarter) and back == day.replace(day=1)
    assert D.first_day(month) == day.replace(day=1)
    assert df.select(D.quarter_label(D.quarter_index("d"))).first()[0] == f"{day.year}q{(day.month + 2) // 3}"


def test_period_texts():
    assert D.period("1960q1") == 0 and D.period("2022m1") == D.ym(2022, 1) == 744
    assert D.period("2025q3") - D.period("2022q1") + 1 == 15
    with pytest.raises(ValueError):
        D.period("2022")


def test_labels_and_logs(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert [r[0] for r in df.select(S.label_values("a", {1: "Low"})).collect()] == ["Low", None, None]
    assert df.select(S.log_plus("a")).first()[0] == pytest.approx(0.0953101798)
