"""Words of a text, as column expressions and as bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_PATTERN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once, and only when this is reached."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
