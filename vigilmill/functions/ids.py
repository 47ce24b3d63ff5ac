"""Identifiers: normalisation, record ids, keyed hashes of authors."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that may pad an identifier, as a regex class.
BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


def trimmed(c: Column) -> Column:
    """Without the blanks around it; null if nothing is left."""
    return F.nullif(F.regexp_extract(c, f"(?s)^{BLANK}*(.*?){BLANK}*$", 1), F.lit(""))


def bare_id(c: Column) -> Column:
    """An id without surrounding blanks and type prefix; null if blank.

    One regex, so that Spark evaluates nothing twice per nesting level.
    """
    return F.nullif(F.regexp_extract(c, f"(?s)^{BLANK}*(?:t[13]_)?{BLANK}*(.*?){BLANK}*$", 1), F.lit(""))


def record_kind(c: Column, default: str) -> Column:
    """``post`` or ``comment`` by prefix, else ``default``."""
    return F.when(c.rlike(f"^{BLANK}*t3_"), F.lit("post")).when(c.rlike(f"^{BLANK}*t1_"), F.lit("comment")).otherwise(F.lit(default))


def prefixed_id(c: Column, default: str) -> Column:
    """The bare id with its type prefix; null if blank."""
    return F.concat(F.when(record_kind(c, default) == "post", F.lit("t3_")).otherwise(F.lit("t1_")), bare_id(c))


def record_id(given: list[Column], parts: list[Column]) -> Column:
    """First non-blank given id, else 24 hex digits of SHA-256 over ``parts``.

    The parts are joined by U+001F; nulls count as empty.
    """
    known = [F.nullif(F.coalesce(g, F.lit("")), F.lit("")) for g in given]
    made = F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 24)
    return F.coalesce(*known, made)


def hmac_sha256(text: Column, salt: bytes) -> Column:
    """HMAC-SHA-256 as hex, from two nested ``sha2`` calls (no UDF)."""
    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def author_hash(author: Column, salt: bytes) -> Column:
    """32 hex digits for an author, case ignored; empty for missing or deleted ones."""
    from .text import squeeze

    a = F.lower(squeeze(author))
    return F.when(a.isin("", "[deleted]", "deleted"), F.lit("")).otherwise(F.substring(hmac_sha256(a, salt), 1, 32))
