from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from conftest import dicts, rows
from rowloom.functions.dates import resolve_path_tokens
from rowloom.functions.labels import duration_label
from rowloom.functions.values import as_text, cast_value, common_type, field, literal_moment, micros_between
from rowloom.operators.project import (
    Mapping,
    calculate,
    constant_row,
    duplicate_targets,
    format_mappings,
    parse_mappings,
    select_values,
)
from rowloom.sources.variables import set_variables


def cast_all(spark, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = df.select("i", cast_value(field(df, "s"), kind).col.alias("v")).orderBy("i")
    return [r[1] for r in out.collect()]


def test_text_to_int(spark):
    texts = ["5", " 5 ", "5.0", "5.5", "1e3", "1,000", "-7", "+7", "abc", "", None, "3000000000", "0x1p3", "1d"]
    assert cast_all(spark, texts, "int") == [5, 5, 5, None, 1000, 1000, -7, 7, None, None, None, None, None, None]


def test_text_to_long_and_double(spark):
    assert cast_all(spark, ["3000000000", "1.5"], "long") == [3000000000, None]
    assert cast_all(spark, ["1.5", "1e-3", ".5", "5.", "1d", "NaN", "x"], "double") == [1.5, 0.001, 0.5, 5.0, None, None, None]


def test_text_to_decimal(spark):
    assert cast_all(spark, ["1.25", "1,234.5", "-"], "decimal") == [Decimal("1.25"), Decimal("1234.5"), None]


def test_text_to_bool(spark):
    assert cast_all(spark, ["TRUE", " false ", "yes", "1", None], "bool") == [True, False, None, None, None]


def test_text_to_datetime(spark):
    texts = ["2026/01/05", "2026-1-5 3:04", "2026-01-05 03:04:05.5", "2026-02-30", "soon", "2026-01-05T03:04:05"]
    assert cast_all(spark, texts, "datetime") == [
        datetime(2026, 1, 5),
        datetime(2026, 1, 5, 3, 4),
        datetime(2026, 1, 5, 3, 4, 5, 500000),
        None,
        None,
        datetime(2026, 1, 5, 3, 4, 5),
    ]


@pytest.mark.parametrize("text", ["2026/01/05", "2026-1-5 3:04", "2026-01-05 03:04:05.5", "2026-02-30", "soon"])
def test_literal_moment_agrees_with_column(spark, text):
    assert literal_moment(text) == cast_all(spark, [text], "datetime")[0]


def test_unknown_type_leaves_value(spark):
    assert cast_all(spark, ["x", None], "guid") == ["x", None]


def test_double_text(spark):
    values = [5.0, 0.0, -2.5, 12345678.25, 0.001, 1e20, None]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.select(as_text(field(df, "d")).alias("t")).collect()]
    assert got[:5] == ["5", "0", "-2.5", "12345678.25", "0.001"] and got[6] is None


def test_bool_and_moment_text(spark):
    df = spark.createDataFrame([(True, datetime(2026, 1, 2, 3, 4, 5))], "b boolean, t timestamp_ntz")
    got = df.select(as_text(field(df, "b")).alias("b"), as_text(field(df, "t")).alias("t")).first()
    assert tuple(got) == ("True", "2026/01/02 03:04:05")


def test_common_type():
    assert common_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert common_type(T.LongType(), T.DoubleType()) == T.DoubleType()
    assert common_type(T.StringType(), T.LongType()) == T.StringType()
    assert common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()


def test_micros_ignore_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-03-29 03:30:00' AS a, timestamp_ntz'2026-03-29 01:30:00.25' AS b")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(micros_between(F.col("a"), F.col("b"))).first()[0] == 7199_750_000
        assert df.select(micros_between(F.col("b"), F.col("a"))).first()[0] == -7199_750_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


CALC = [
    ("add", "10", "5", 15.0),
    ("subtract", "10", "3", 7.0),
    ("multiply", "4", "5", 20.0),
    ("divide", "10", "4", 2.5),
    ("divide", "10", "0", None),
    ("add", None, "5", 5.0),
    ("add", "abc", "5", 5.0),
    ("concat", "Hello", "World", "HelloWorld"),
    ("concat", None, "x", "x"),
]


@pytest.mark.parametrize("kind,a,b,expected", CALC)
def test_calculations(spark, kind, a, b, expected):
    df = spark.createDataFrame([(a, b)], "A string, B string")
    got = dicts(calculate(df, kind, "A", "B"))[0]
    assert got == {"A": a, "B": b, "Result": expected}


def test_calculation_of_missing_field_and_unknown_kind(spark):
    df = spark.createDataFrame([("10",)], "A string")
    assert calculate(df, "add", "A", "none").first()["Result"] == 10.0
    with pytest.raises(ValueError, match="unknown calculation"):
        calculate(df, "power", "A", "A")


def test_constant(spark):
    df = spark.range(1)
    assert calculate(df, "constant", value="42").first()["Result"] == 42.0
    assert calculate(df, "constant", value="N/A").first()["Result"] == "N/A"


def test_minutes(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 1, 1, 10, 30), datetime(2026, 1, 1, 9, 0), "2026-01-01", 1.5, 1)],
        "e timestamp_ntz, s timestamp_ntz, t string, d double, i int",
    )
    minutes = lambda a, b: calculate(df, "dateDiffMinutes", a, b).first()["Result"]
    assert minutes("e", "s") == 90.0
    assert minutes("s", "e") == -90.0
    assert minutes("d", "i") == 720.0
    assert minutes("t", "t") == 0.0


def test_calculation_replaces_column(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert dicts(calculate(df, "add", "a", "b", "A")) == [{"a": 3.0, "b": "2"}]


def test_mappings_round_trip():
    text = "a|b|int|true|\nc=d\ne\nx||string|FALSE|\n|k|||p|q|r\n\n|||true|"
    items = parse_mappings(text)
    assert items == [
        Mapping("a", "b", "int"),
        Mapping("c", "d"),
        Mapping("e"),
        Mapping("x", "", "string", False),
        Mapping("", "k", "", True, "p|q|r"),
    ]
    assert parse_mappings(format_mappings(items)) == items


def test_select_values(spark):
    df = spark.createDataFrame([(1, "2", "x")], "a int, b string, c string")
    out = select_values(df, "b|n|int\na\nnone\nc|gone||false\n|k||true|v\na|n|string")
    assert out.columns == ["n", "a", "k"]
    assert dicts(out) == [{"n": "1", "a": 1, "k": "v"}]
    assert select_values(df, "") is df
    assert duplicate_targets(parse_mappings("a|x\nb|X\nc")) == ["X"]
    with pytest.raises(ValueError, match="mapped twice"):
        select_values(df, "a|x\nb|x", strict=True)


def test_select_constants_on_empty_input(spark):
    empty = spark.createDataFrame([], "a int")
    assert select_values(empty, "|k|int|true|7").count() == 0
    assert rows(select_values(empty, "|k|int|true|7", emit_on_empty=True)) == [(7,)]
    assert rows(constant_row(spark, "|k|int|true|7\n|w|||z")) == [(7, "z")]


AS_OF = datetime(2026, 3, 31, 14, 30, 22)


def test_variables(spark):
    text = (
        "FROM_DATE=TODAY-30\r\nTO=today\nDEPT=01\n=x\nnothing\nN=NOW\nY=YESTERDAY\nPS=PREV_MONTH_START\n"
        "PE=PREV_MONTH_END\nME=MONTH_END_DT\nYE=YEAR_END\nTE=TODAY_END\nYS=YESTERDAY_START\nDEPT=02\nE=\nA=TODAY+1"
    )
    got = dicts(set_variables(spark, text, as_of=AS_OF))
    assert got == [
        {
            "FROM_DATE": "2026/03/01",
            "TO": "2026/03/31",
            "DEPT": "02",
            "N": "2026/03/31 14:30:22",
            "Y": "2026/03/30",
            "PS": "2026/02/01",
            "PE": "2026/02/28",
            "ME": "2026/03/31 23:59:59",
            "YE": "2026/12/31",
            "TE": "2026/03/31 23:59:59",
            "YS": "2026/03/30 00:00:00",
            "E": "",
            "A": "2026/04/01",
        }
    ]
    assert set_variables(spark, "D=TODAY", "yyyy-MM-dd", AS_OF).first()["D"] == "2026-03-31"
    assert set_variables(spark, "D=TODAY").count() == 1
    with pytest.raises(ValueError, match="unsupported code"):
        set_variables(spark, "D=TODAY", "dddd")


def test_path_tokens():
    at = datetime(2026, 4, 3, 14, 30, 22)
    assert resolve_path_tokens("data_{yyyyMMdd}_{HHmmss}.csv", at) == "data_20260403_143022.csv"
    assert resolve_path_tokens("/x/{yyyy}/{MM-dd}.csv", at) == "/x/2026/04-03.csv"
    assert resolve_path_tokens("plain.csv", at) == "plain.csv"
    assert resolve_path_tokens("{user}.csv", at) == "{user}.csv"


def test_duration_label(spark):
    df = spark.createDataFrame([(950,), (12300,), (125999,), (60000,), (0,)], "ms long")
    got = [r[0] for r in df.select(duration_label(F.col("ms"))).collect()]
    assert got == ["950ms", "12.3s", "2m05s", "1m00s", "0ms"]
