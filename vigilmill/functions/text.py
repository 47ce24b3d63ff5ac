"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Unicode white space to single blanks, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def half_even(x: Column, digits: int) -> Column:
    """Rounding half to even, as IEEE arithmetic does."""
    k = float(10**digits)
    return F.rint(x * F.lit(k)) / F.lit(k)


def iso_utc(epoch: Column) -> Column:
    """Epoch seconds as ISO-8601 text with ``+00:00``; empty if null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def epoch_seconds(c: Column) -> Column:
    """Any number-like value as whole seconds, truncated; null if none."""
    return F.expr(f"try_cast(try_cast({_name(c)} as double) as bigint)") if isinstance(c, str) else c.try_cast("double").try_cast("bigint")


def _name(c: str) -> str:
    return f"`{c}`"


def is_withdrawn(c: Column) -> Column:
    """True where the text is a deletion marker, in any case."""
    return F.coalesce(F.lower(F.trim(c)).isin("[deleted]", "[removed]"), F.lit(False))


def last_chars(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def first_chars(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))
