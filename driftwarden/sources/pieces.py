"""The input of a load: one or more frames, each with a single physical layout.

A drifting source is a handful of layouts, each holding any number of batches. Keeping the
layouts apart lets every column keep its own Spark type, so a clean column costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions import buckets
from driftwarden.functions.coercion import looks_float, looks_integer
from driftwarden.functions.sql import literal, named, words

SOURCE, BATCH, ERROR, TOKENS, BAD = "_source", "_batch", "_error", "_tokens", "_bad"
RESERVED = (SOURCE, BATCH, TOKENS, BAD)

# Names the load gives to columns of its own, in any spelling, since Spark may ignore case.
_INTERNAL = re.compile(
    r"(data:)*_(source|batch|error|tokens|bad|ids|salt|place|part|offset|position|n|file|block|line|failed|record|hint"
    r"|version|type|detail|column|other_keys|beyond_header(_2)?|corrupt_line|(number|move)_.*)",
    re.IGNORECASE | re.DOTALL,
)
_APART = "data:"

# The words a delimited file spells booleans with.
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")


def safe_name(name: str) -> str:
    """The name a data column has within a load: its own, or set apart where the load uses that name."""
    return _APART + name if _INTERNAL.fullmatch(name) else name


def own_name(name: str) -> str:
    """The data's own name of a column of a load."""
    bare = name.removeprefix(_APART)
    return bare if bare != name and _INTERNAL.fullmatch(bare) else name


def with_safe_names(frame: DataFrame) -> DataFrame:
    names = [safe_name(c) for c in frame.columns]
    return frame if names == frame.columns else frame.toDF(*names)


def with_own_names(frame: DataFrame) -> DataFrame:
    names = [own_name(c) for c in frame.columns]
    return frame if names == frame.columns else frame.toDF(*names)


@dataclass(frozen=True)
class Piece:
    """Rows of one layout: ``_source``, ``_batch`` and the data columns.

    ``judged``: a user transform was applied, so ``_error`` tells its bad rows and is no data.

    ``inferred`` maps a text column to how its bucket is told from the values of a batch:
    ``"text"`` (by spelling) or ``"json"`` (by the token types kept in ``_tokens``), or ``"rest"`` (JSON text of keys that are no columns). Of these, the ``dated`` ones are times where
    all values of a batch can be read as such. ``carried`` columns are no data: they go along with the clean rows.

    ``malformed``: lines that could not be read (``_source``, ``_batch``, line, file, place). In the frame such a line is a row
    whose ``_bad`` is true: it is counted, and is no row of the batch otherwise.
    """

    frame: DataFrame
    inferred: Mapping[str, str] = field(default_factory=dict)
    judged: bool = False
    carried: tuple[str, ...] = ()
    dated: frozenset[str] = frozenset()
    malformed: DataFrame | None = None

    def __post_init__(self) -> None:
        missing = [c for c in (SOURCE, BATCH, *self.carried) if c not in self.frame.columns]
        if missing:
            raise ValueError(f"a piece needs the columns {', '.join(missing)}")

    @property
    def columns(self) -> list[str]:
        hidden = (*RESERVED, ERROR) if self.judged else RESERVED
        return [c for c in self.frame.columns if c not in hidden and c not in self.carried]

    @property
    def rows(self) -> DataFrame:
        """The rows that could be read."""
        return self.frame if self.malformed is None else self.frame.where(f"NOT {BAD}").drop(BAD)

    @property
    def has_errors(self) -> bool:
        return self.judged and ERROR in self.frame.columns

    def type_of(self, column: str) -> T.DataType:
        return self.frame.schema[column].dataType

    def declared_bucket(self, column: str) -> str | None:
        """Bucket of a typed column, None for a column whose bucket depends on the batch."""
        return None if column in self.inferred else buckets.bucket_of(self.type_of(column))

    def transformed(self, custom) -> Piece:
        """The piece after a user function; columns it casts stop being inferred."""
        frame = custom(self.frame)
        kept = {
            c: how
            for c, how in self.inferred.items()
            if c in frame.columns and isinstance(frame.schema[c].dataType, T.StringType)
        }
        return replace(self, frame=frame, inferred=kept, judged=True)

    def seen(self, column: str) -> str | None:
        """Condition "this row has the column", None where every row has it."""
        if self.inferred.get(column) == "json":
            return f"map_contains_key({TOKENS}, {literal(own_name(column))})"
        return f"{named(column)} IS NOT NULL" if self.inferred.get(column) == "rest" else None

    def token(self, column: str) -> str | None:
        """The JSON token type of a value, None where values have none."""
        if self.inferred.get(column) == "json":
            return f"schema_of_variant({TOKENS}[{literal(own_name(column))}])"
        return "'STRING'" if self.inferred.get(column) == "rest" else None


def looks(text: str, token: str | None, number: str) -> dict[str, str]:
    """Conditions by which one value of an inferred column looks like a bucket."""
    if token is not None:
        return {
            buckets.INTEGER: f"{token} = 'BIGINT'",
            buckets.FLOAT: f"({token} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({token}, 'DECIMAL'))",
            buckets.BOOLEAN: f"{token} = 'BOOLEAN'",
        }
    return {
        buckets.INTEGER: looks_integer(text, number),
        buckets.FLOAT: looks_float(text, number),
        buckets.BOOLEAN: f"{text} IN ({words(BOOLEAN_WORDS)})",
    }


def tag(frame: DataFrame, source_name: str, batch: Column | None = None) -> DataFrame:
    """Add the source name and the batch key (one batch when none is given)."""
    key = F.lit(0).cast("bigint") if batch is None else batch
    return frame.withColumns({SOURCE: F.lit(source_name), BATCH: key})
