"""Null-safe coercion between buckets, as SQL expressions only.

Nothing here raises on bad data: a value that does not fit the target becomes null, and the
caller compares ``present`` before and after to find the failures. Expressions are SQL text for
``F.expr``, so that a wide layout is described with few calls and runs as generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.buckets import BOOLEAN, COERCIBLE, DATETIME, FLOAT, INTEGER, STRING, UNKNOWN, bucket_of
from driftwarden.functions.sql import literal, named, pattern, words
from driftwarden.options import Options

# The text forms read as numbers, booleans and infinities.
NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"
WHOLE_NUMBER = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
INFINITY = r"^[ \t]*[+-]?(inf|infinity)[ \t]*$"
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

EXACT_LIMIT = 9007199254740992  # 2**53: whole doubles up to here are exact
LONG_LIMIT = "9223372036854775808D"  # 2**63
INFINITE = "double('Infinity')"

_EPOCH_MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def present(value: str, data_type: T.DataType) -> str:
    """Not null, where NaN counts as null."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"({value} IS NOT NULL AND NOT isnan({value}))"
    return f"({value} IS NOT NULL)"


def stripped(text: str) -> str:
    return f"trim(BOTH ' \\t' FROM {text})"


def text_number(text: str) -> str:
    """The number a text spells, or null. Overflowing literals such as 1e999 give infinity.

    This is the only regular expression of the numeric conversions. Callers that use it more than
    once per value add it as a column of its own first (``with_numbers``), so that it runs once.
    """
    return f"try_cast(CASE WHEN {text} RLIKE {pattern(NUMBER)} THEN {stripped(text)} END AS double)"


def text_to_float(text: str, number: str, allow_inf: bool = False) -> str:
    if not allow_inf:
        return f"(CASE WHEN abs({number}) < {INFINITE} THEN {number} END)"
    sign = f"CASE WHEN startswith({stripped(text)}, '-') THEN -{INFINITE} ELSE {INFINITE} END"
    spelled = f"lower({text}) RLIKE {pattern(INFINITY)}"
    return f"coalesce({number}, CASE WHEN {spelled} THEN {sign} END)"


def whole_number(text: str, number: str) -> str:
    """Digits only, and small enough for a bigint. Only such text reaches the cast: a cast that
    fails is far dearer than a second pattern."""
    digits = f"{number} IS NOT NULL AND {text} RLIKE {pattern(WHOLE_NUMBER)}"
    return f"(CASE WHEN {digits} THEN try_cast({stripped(text)} AS bigint) END)"


def text_to_integer(text: str, number: str) -> str:
    integral = f"{number} = floor({number}) AND abs({number}) <= {EXACT_LIMIT}"
    fitting = f"CASE WHEN {integral} THEN CAST({number} AS bigint) END"
    return f"coalesce({whole_number(text, number)}, {fitting})"


def looks_integer(text: str, number: str) -> str:
    return f"({whole_number(text, number)} IS NOT NULL)"


def looks_float(text: str, number: str) -> str:
    return f"({number} IS NOT NULL OR lower({text}) RLIKE {pattern(INFINITY)})"


def number_column(column: str) -> str:
    return f"_number_{column}"


def with_numbers(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Add the parsed number of some text columns, for the expressions of the next step."""
    if not columns:
        return frame
    return frame.withColumns({number_column(c): F.expr(text_number(named(c))) for c in columns})


def text_to_boolean(text: str) -> str:
    word = f"lower(trim(BOTH ' \\t\\n\\r' FROM {text}))"
    return f"(CASE WHEN {word} IN ({words(TRUE_WORDS)}) THEN true WHEN {word} IN ({words(FALSE_WORDS)}) THEN false END)"


def text_to_datetime(text: str, formats: tuple[str, ...]) -> str:
    plain, tries = stripped(text), []
    for fmt in formats:
        attempt, shape = f"try_to_timestamp({plain}, {literal(fmt)})", format_shape(fmt)
        if shape is not None:
            # a failing parse is far dearer than a pattern that no readable text can miss
            attempt = f"CASE WHEN {plain} RLIKE {pattern(shape)} THEN {attempt} END"
        tries.append(attempt)
    return f"coalesce({', '.join(tries)})"


def format_shape(fmt: str) -> str | None:
    """A loose pattern that every text of a time format fits, None for formats with optional parts."""
    if "[" in fmt or "''" in fmt:
        return None
    shape, quoted, last = "", False, ""
    for char in fmt:
        if char == "'":
            quoted, last = not quoted, ""
        elif char.isalpha() and not quoted:
            if char != last:
                shape += "[+-]?[0-9]+" if char in "yudHhKkmsS" else ".+"
            last = char
        else:
            shape += re.escape(char)
            last = ""
    return None if "'" in shape else f"^{shape}$"


def number_to_datetime(number: str, epoch_unit: str | None) -> str:
    if epoch_unit is None:
        return "CAST(NULL AS timestamp)"
    return f"timestamp_micros(try_cast({number} * {_EPOCH_MICROS[epoch_unit]} AS bigint))"


def as_text(value: str, data_type: T.DataType) -> str:
    """Text of a value of any type; nested values as JSON."""
    if isinstance(data_type, T.BooleanType):
        return f"(CASE WHEN {value} THEN 'True' WHEN NOT {value} THEN 'False' END)"
    if isinstance(data_type, _NESTED):
        return f"to_json({value})"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"(CASE WHEN NOT isnan({value}) THEN CAST({value} AS string) END)"
    return f"CAST({value} AS string)"


def coerce(
    value: str, data_type: T.DataType, target: str, options: Options, number: str | None = None
) -> str:
    """``value`` moved toward the bucket ``target``; null where it does not fit.

    A target without a conversion leaves the value as it is. ``number`` is the already parsed
    number of a text value.
    """
    source = bucket_of(data_type)
    if source == target or target not in COERCIBLE:
        return value
    if source == UNKNOWN:
        return f"CAST(NULL AS {_TARGET_TYPES[target]})"
    if target == STRING:
        return as_text(value, data_type)

    if source == INTEGER:
        return {
            FLOAT: f"CAST({value} AS double)",
            BOOLEAN: f"({value} <> 0)",
            DATETIME: number_to_datetime(value, options.epoch_unit),
        }[target]
    if source == FLOAT:
        wide = f"CAST({value} AS double)"
        whole = f"{wide} = floor({wide}) AND abs({wide}) < {LONG_LIMIT}"
        return {
            INTEGER: f"(CASE WHEN {whole} THEN try_cast({wide} AS bigint) END)",
            BOOLEAN: f"(CASE WHEN NOT isnan({value}) THEN {value} <> 0 END)",
            DATETIME: number_to_datetime(wide, options.epoch_unit),
        }[target]
    if source == BOOLEAN:
        return {
            INTEGER: f"CAST({value} AS bigint)",
            FLOAT: f"CAST({value} AS double)",
            DATETIME: "CAST(NULL AS timestamp)",
        }[target]
    if source == DATETIME:
        nanos = f"(unix_micros(CAST({value} AS timestamp)) * 1000)"
        return {
            INTEGER: nanos,
            FLOAT: f"CAST({nanos} AS double)",
            BOOLEAN: "CAST(NULL AS boolean)",
        }[target]

    text = value if source == STRING else as_text(value, data_type)
    parsed = number or text_number(text)
    return {
        INTEGER: text_to_integer(text, parsed),
        FLOAT: text_to_float(text, parsed, options.allow_inf),
        BOOLEAN: text_to_boolean(text),
        DATETIME: text_to_datetime(text, options.datetime_formats),
    }[target]


_TARGET_TYPES = {INTEGER: "bigint", FLOAT: "double", BOOLEAN: "boolean", DATETIME: "timestamp", STRING: "string"}

# (source, target) pairs in which a present value always fits
_NEVER_LOSES = {
    (INTEGER, FLOAT), (INTEGER, BOOLEAN), (FLOAT, BOOLEAN), (BOOLEAN, INTEGER), (BOOLEAN, FLOAT),
    (DATETIME, INTEGER), (DATETIME, FLOAT),
}


def losing(
    value: str, data_type: T.DataType, target: str, options: Options, number: str | None = None
) -> str | None:
    """Condition "present before, null after", or None where that cannot happen."""
    source = bucket_of(data_type)
    if source in (target, UNKNOWN) or target not in COERCIBLE or target == STRING:
        return None
    if (source, target) in _NEVER_LOSES:
        return None
    return f"({present(value, data_type)} AND {coerce(value, data_type, target, options, number)} IS NULL)"
