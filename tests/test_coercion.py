import math
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from driftwarden.functions.buckets import bucket_of, schema_of
from driftwarden.functions.coercion import coerce, losing, text_to_datetime
from driftwarden.functions.sql import literal
from driftwarden.options import Options

# text -> (integer, float)
NUMBERS = {
    "12": (12, 12.0), " 12 ": (12, 12.0), "+7": (7, 7.0), "-7": (-7, -7.0),
    "1.0": (1, 1.0), "1.": (1, 1.0), "1e3": (1000, 1000.0), ".5": (None, 0.5),
    "1.5": (None, 1.5), "1_000": (None, None), "0x10": (None, None), "1d": (None, None), "1f": (None, None),
    "inf": (None, None), "-Infinity": (None, None), "nan": (None, None), "": (None, None),
    "99999999999999999999": (None, 1e20), "9223372036854775807": (2**63 - 1, 9.223372036854775807e18),
    "1e999": (None, None), "$5.00": (None, None), "1,000": (None, None), "abc": (None, None),
}


def column(spark, values, ddl):
    return spark.createDataFrame([(v,) for v in values], f"v {ddl}")


def coerced(frame, target, options=Options()):
    data_type = frame.schema["v"].dataType
    lost = losing("v", data_type, target, options) or "false"
    rows = frame.selectExpr("v", f"{coerce('v', data_type, target, options)} AS r", f"{lost} AS lost").collect()
    return {row["v"]: (row["r"], row["lost"]) for row in rows}


def test_numeric_text(spark):
    frame = column(spark, NUMBERS, "string")
    whole, real = coerced(frame, "integer"), coerced(frame, "float")
    for text, (as_integer, as_float) in NUMBERS.items():
        assert whole[text] == (as_integer, as_integer is None), text
        assert real[text] == (as_float, as_float is None), text


def test_null_text_is_no_failure(spark):
    assert coerced(column(spark, [None], "string"), "float") == {None: (None, False)}


def test_infinity_is_an_option(spark):
    found = coerced(column(spark, ["inf", "-inf", "1e999", "x"], "string"), "float", Options(allow_inf=True))
    assert found["inf"] == (math.inf, False) and found["-inf"] == (-math.inf, False)
    assert found["1e999"] == (math.inf, False) and found["x"] == (None, True)


def test_boolean_text(spark):
    true, false = ["true", "1", " Yes", "y", "T"], ["false", "0", "No ", "n", "F"]
    found = coerced(column(spark, [*true, *false, "maybe", "2", ""], "string"), "boolean")
    assert all(found[t] == (True, False) for t in true)
    assert all(found[t] == (False, False) for t in false)
    assert found["maybe"] == found["2"] == found[""] == (None, True)


def test_datetime_text(spark):
    formats = Options(datetime_formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"))
    values = ["2024-01-01 10:00:00", " 2024-01-01", "01/02/2024", "20240101", "2024", "n/a"]
    found = coerced(column(spark, values, "string"), "datetime", formats)
    assert [found[v][1] for v in values] == [False, False, False, True, True, True]


@pytest.mark.parametrize("fmt", [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "MMM d, yyyy", "yyyyMMdd", "dd.MM.yy", "d/M/y h:mm a", "yyyy-MM-dd[ HH:mm]",
])
def test_format_shapes_let_every_readable_text_through(spark, fmt):
    texts = spark.sql("select timestamp'2024-01-05 10:20:30' + make_dt_interval(id * 97, id * 7) t from range(200)")
    texts = texts.select(F.date_format("t", fmt.replace("[", "").replace("]", "")).alias("v"))
    found = texts.selectExpr(
        f"try_to_timestamp(v, {literal(fmt)}) a", f"{text_to_datetime('v', (fmt,))} b"
    ).selectExpr("count_if(a <=> b)", "count(a)").first()
    assert tuple(found) == (200, 200)


@pytest.mark.parametrize(
    ("ddl", "value", "target", "result", "lost"),
    [
        ("bigint", 3, "float", 3.0, False),
        ("bigint", 3, "boolean", True, False),
        ("bigint", 0, "boolean", False, False),
        ("bigint", 3, "datetime", None, True),
        ("bigint", 3, "string", "3", False),
        ("double", 3.0, "integer", 3, False),
        ("double", 3.5, "integer", None, True),
        ("double", math.inf, "integer", None, True),
        ("double", 1e18, "integer", 10**18, False),
        ("double", 0.0, "boolean", False, False),
        ("double", 1.5, "string", "1.5", False),
        ("boolean", True, "integer", 1, False),
        ("boolean", False, "float", 0.0, False),
        ("boolean", True, "string", "True", False),
        ("boolean", True, "datetime", None, True),
        ("timestamp_ntz", datetime(1970, 1, 1, 0, 0, 1), "integer", 10**9, False),
        ("timestamp_ntz", datetime(1970, 1, 1, 0, 0, 1), "boolean", None, True),
        ("decimal(10,2)", Decimal("3.00"), "integer", 3, False),
        ("decimal(10,2)", Decimal("3.50"), "integer", None, True),
        ("date", date(2024, 1, 1), "string", "2024-01-01", False),
    ],
)
def test_typed_values(spark, ddl, value, target, result, lost):
    assert coerced(column(spark, [value], ddl), target) == {value: (result, lost)}


def test_nan_counts_as_null(spark):
    frame = column(spark, [math.nan], "double")
    ((_, (result, lost)),) = coerced(frame, "integer").items()
    assert result is None and not lost
    ((_, (result, lost)),) = coerced(frame, "string").items()
    assert result is None and not lost


def test_epoch_numbers(spark):
    found = coerced(column(spark, [1], "bigint"), "datetime", Options(epoch_unit="s"))
    moment, lost = found[1]
    assert moment.replace(tzinfo=None) == datetime(1970, 1, 1, 0, 0, 1, tzinfo=UTC).astimezone().replace(tzinfo=None)
    assert not lost


def test_target_without_conversion_is_left_alone(spark):
    assert coerced(column(spark, ["x"], "string"), "decimal(10,2)") == {"x": ("x", False)}


def test_buckets(spark):
    frame = spark.sql("""
        select 1Y a, 1 b, 1.0D c, 1.0F d, true e, 'x' f, timestamp'2024-01-01 00:00:00' g,
          timestamp_ntz'2024-01-01 00:00:00' h, interval '1' day i, 1.50 j, date'2024-01-01' k, array(1) l, null m
    """)
    assert list(schema_of(frame).values()) == [
        "integer", "integer", "float", "float", "boolean", "string", "datetime", "datetime", "timedelta",
        "decimal(3,2)", "date", "array<int>", "unknown",
    ]
    assert bucket_of(frame.schema["l"].dataType, nested_as="string") == "string"
