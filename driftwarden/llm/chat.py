"""Chat formatting: a finite-state machine over roles writes each conversation by a declarative template.

The output is a list of segments, each with a flag that says whether it counts in the loss, so that
joining the segments gives the text and the flags give the mask. The loss covers exactly the texts of
assistant turns. Control strings inside texts and roles are escaped reversibly: ``<|`` becomes ``<\\|``, and
every further backslash between the two signs gains one more, so ordinary text stays as it is.

Defined results: a null text is an empty text, a null role an empty role, a null turn comes first. Rows of
one turn number are ordered by role and text, so repeated rows all stay, side by side. Conversations with a
null id form one conversation with a null id. A turn order the machine refuses is still formatted
whole; ``valid`` is false and ``fault`` tells the first refused turn. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, and which roles may follow which."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: backslash and line break are written as two signs."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(turns: list[tuple[str, str]], template: Template) -> list[tuple[str, bool]]:
    """Pieces of the formatted text and whether each counts in the loss."""
    made = []
    for role, text in turns:
        made.append((template.head.format(role=escape_role(role)), False))
        made.append((escape(text), role in template.loss_roles))
        made.append((template.tail, False))
    return made


def fault(roles: list[str], template: Template) -> int | None:
    """The first turn that the machine refuses; the number of turns if only the end is wrong; else nothing."""
    state = template.start
    for i, role in enumerate(roles):
        state = template.moves.get(state, {}).get(role)
        if state is None:
            return i
    return None if state in template.final else len(roles)


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    before, after = template.head.split("{role}")
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(before, at):
            raise ValueError(f"no turn begins at {at}")
        named = formatted.index(after, at + len(before))
        end = formatted.index(template.tail, named + len(after))
        turns.append((unescape_role(formatted[at + len(before) : named]), unescape(formatted[named + len(after) : end])))
        at = end + len(template.tail)
    return turns


FORMATTED = (
    "conv_id long, n_turns long, valid boolean, fault long, segments array<struct<text: string, loss: boolean>>"
)
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text), with its segments.

    A conversation is one output text, so its turns meet in one task; nothing else does.
    """
    template = template or Template()
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[(t["role"], t["text"]) for t in turns] for turns in batch.column("turns").to_pylist()]
            faults = [fault([r for r, _ in turns], template) for turns in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id").cast(pa.int64()),
                    pa.array([len(turns) for turns in kept], pa.int64()),
                    pa.array([f is None for f in faults], pa.bool_()),
                    pa.array(faults, pa.int64()),
                    pa.array(
                        [[{"text": t, "loss": f} for t, f in segments(turns, template)] for turns in kept], _SEGMENTS
                    ),
                ],
                names=["conv_id", "n_turns", "valid", "fault", "segments"],
            )

    return whole.select("conv_id", "turns").mapInArrow(written, FORMATTED)
