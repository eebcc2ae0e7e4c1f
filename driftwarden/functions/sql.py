"""Small helpers for expressions written as SQL text, which cost one call each to build."""

from __future__ import annotations


def literal(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """A regular expression as a raw string literal."""
    return f"r'{regex}'"


def named(name: str) -> str:
    """A column by exact name; dots and back-quotes in the name are data."""
    return "`" + name.replace("`", "``") + "`"


def words(values) -> str:
    """The inside of an IN list."""
    return ", ".join(literal(v) for v in values)
