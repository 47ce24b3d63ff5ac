"""Visually identical text with different characters.

Two steps. *Folding* needs no corpus: composed form, full-width and half-width
forms, joined letters, invisible characters and blanks. *Script-aware repair*
does: per token the dominant script is that of its letters without a look-alike;
look-alikes of other scripts are substituted towards it, only in tokens that mix
scripts (or that consist of look-alikes alone in a Latin text), and only if the
result is a word of the corpus. Everything that works on whole texts is one pass of Arrow batches over
the dirty rows; the vocabulary and the repairs are tables, never collected.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, free_name, spread

# Letters of other alphabets with the shape of a Latin letter.
CYRILLIC = "аеорсухһіїјѕԁԛԝӏѵАВЕЅІЇЈКМНОРСТУХҮԚԜӀ"
CYRILLIC_AS = "aeopcyxhiïjsdqwlvABESIÏJKMHOPCTYXYQWI"
GREEK = "αονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_AS = "aovpcjABEZHIKMNOPTYXC"
ARMENIAN = "օսոհցՕՍԼ"
ARMENIAN_AS = "ounhgOUL"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
OTHER_LATIN = "ɑɡ"
OTHER_LATIN_AS = "ag"
LOOKALIKE = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + OTHER_LATIN, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + OTHER_LATIN_AS, strict=True))


def _accented() -> dict[str, str]:
    """Letters that are a look-alike with accents, as the Latin letter with them."""
    out = {}
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in LOOKALIKE:
            latin = unicodedata.normalize("NFC", LOOKALIKE[base] + "".join(marks))
            if len(latin) == 1:
                out[chr(code)] = latin
    return out


LOOKALIKE |= {k: v for k, v in _accented().items() if k not in LOOKALIKE}
#: The other way round, by script: Latin letters as letters of that script.
AS_SCRIPT: dict[str, dict[int, str]] = {}
for _s, _own, _latin in (("CYRILLIC", CYRILLIC, CYRILLIC_AS), ("GREEK", GREEK, GREEK_AS), ("ARMENIAN", ARMENIAN, ARMENIAN_AS)):
    AS_SCRIPT[_s] = {ord(b): a for a, b in reversed(list(zip(_own, _latin, strict=True)))}

# Characters that show nothing, beyond Unicode's format class Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
# Blanks within a line; line breaks are not blanks.
BLANKS = "\t               　"
# Hyphens that differ from the plain one in line breaking only.
PLAIN_HYPHEN = "‐‑"

#: Compatibility classes of Unicode whose members look like what they decompose to.
_SAME_LOOK = {"<wide>", "<narrow>"}
_WORD = re.compile(r"[^\W\d_]+(?:[’'ʼ][^\W\d_]+)*")
#: A text that needs no folding: printable ASCII and line feeds, no blank at an end.
CLEAN = r"(?s)^(?:[!-~](?:[ -~\n]*[!-~])?)?$"


def _fold_char(c: str) -> str:
    """What ``c`` looks like on its own; itself if nothing else."""
    if c in BLANKS:
        return " "
    if c in INVISIBLE or unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if c in PLAIN_HYPHEN:
        return "-"
    if c == "µ":  # the micro sign is a mu
        return "μ"
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        kind, *parts = d.split()
        text = "".join(chr(int(p, 16)) for p in parts)
        if kind in _SAME_LOOK or (kind == "<compat>" and len(text) > 1 and text.isalpha()):
            return "".join(_fold_char(x) for x in text) if text != c else c
    return c


class _Folds(dict):
    """Table for str.translate that fills itself."""

    def __missing__(self, key: int) -> str:
        self[key] = value = _fold_char(chr(key))
        return value


def fold(text: str, table: dict | None = None) -> str:
    """Composed, plain-width text without invisible characters; all blanks
    plain, none at the ends. Line breaks, case, accents and digits stay."""
    table = _Folds() if table is None else table
    out = unicodedata.normalize("NFC", text).translate(table)
    return unicodedata.normalize("NFC", out).strip(" ")


def script(c: str) -> str:
    """A coarse script name of a letter."""
    if c < "ɐ":
        return "LATIN"
    name = unicodedata.name(c, "?")
    return name.split()[0] if not name.startswith("CJK") else "HAN"


def dominant(token: str) -> str | None:
    """The script of the token's letters that look like no letter of another
    one; ``LATIN`` if there are none, None if they are of several."""
    own = {script(c) for c in token if c.isalpha() and c not in LOOKALIKE}
    for s in own - {"LATIN"}:
        if s in AS_SCRIPT:  # Latin letters may stand for its own
            own = {script(c) for c in token if c.isalpha() and c not in LOOKALIKE and ord(c) not in AS_SCRIPT[s]}
            break
    return own.pop() if len(own) == 1 else None if own else "LATIN"


_LOOK = str.maketrans(LOOKALIKE)


def as_latin(token: str) -> str:
    return unicodedata.normalize("NFC", token.translate(_LOOK))


def plain_form(token: str) -> str:
    """The token with all look-alikes as letters of its dominant script."""
    s = dominant(token)
    return as_latin(token) if s == "LATIN" else token.translate(AS_SCRIPT[s]) if s in AS_SCRIPT else token


def suspects(text: str) -> list[str]:
    """Tokens of a folded text that may hold substituted letters, once each.

    A token is suspect if it mixes letters of its dominant script with
    look-alikes of another one, or has nothing but look-alikes of Latin
    letters while most letters of the text are Latin.
    """
    if text.isascii():
        return []
    found = dict.fromkeys(w for w in _WORD.findall(text) if not w.isascii() and (any(c in LOOKALIKE for c in w) or any(c.isascii() for c in w)))
    if not found:
        return []
    letters = [c for c in text if c.isalpha()]
    latin = sum(c < "ɐ" for c in letters) * 2 > len(letters)
    out = []
    for w in found:
        s = dominant(w)
        if s == "LATIN":
            if any(c in LOOKALIKE for c in w) and (latin or any(c.isalpha() and c < "ɐ" for c in w)):
                out.append(w)
        elif s in AS_SCRIPT and any(ord(c) in AS_SCRIPT[s] for c in w):
            out.append(w)
    return out


def look(text: str, table: dict | None = None) -> str:
    """Folded text with look-alikes in suspect tokens as Latin letters: the
    comparison form where no vocabulary is at hand (word comparison)."""
    if text.isascii():
        return text.strip(" ").replace("\t", " ")
    f = fold(text, table)
    bad = set(suspects(f))
    return _WORD.sub(lambda m: plain_form(m[0]) if m[0] in bad else m[0], f) if bad else f


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _Folds()
    for b in batches:
        texts = b["text"].to_pylist()
        folds = [fold(t, table) for t in texts]
        yield pa.RecordBatch.from_arrays([b["raw"], pa.array(folds, pa.string()), pa.array([suspects(f) for f in folds], pa.list_(pa.string()))], ["raw", "folded", "tokens"])


def _plain_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["token"], pa.array([plain_form(t) for t in b["token"].to_pylist()], pa.string())], ["token", "repaired"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch that could be the result of a repair: of one script."""
    pure = re.compile(r"[A-Za-zÀ-ɏ]+(?:[’'ʼ][A-Za-zÀ-ɏ]+)*|[Ͱ-Ͽἀ-῿]+|[Ѐ-ԯ]+|[԰-֏]+")
    for b in batches:
        seen = set(pure.findall("\n".join(t for t in b["text"].to_pylist() if t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, good in zip(b["folded"].to_pylist(), b["good"].to_pylist(), strict=True):
            if good:
                bad = set(good)
                text = _WORD.sub(lambda m: plain_form(m[0]) if m[0] in bad else m[0], text)
            out.append(text)
        yield pa.RecordBatch.from_arrays([b["raw"], pa.array(out, pa.string()), pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in out], pa.string())], ["raw", "repaired", "key"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word``: the distinct words of one script of all of ``texts`` (column text)."""
    return spread(texts.select("text")).mapInArrow(_words, "word string").distinct()


def repairs(suspect_tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``token, repaired`` for suspect tokens whose plain form is a word.

    A word is one of ``words``, or a form that at least two different suspect
    spellings lead to (so two disguised copies agree without a plain one).
    """
    cand = suspect_tokens.select("token").distinct().mapInArrow(_plain_forms, "token string, repaired string")
    agreed = cand.groupBy("repaired").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("repaired").alias("word"))
    known = words.join(cand.select(F.col("repaired").alias("word")).distinct(), "word", "left_semi").unionByName(agreed).distinct()
    return cand.join(known.withColumnRenamed("word", "repaired"), "repaired", "left_semi").select("token", "repaired")


def is_clean(c: Column) -> Column:
    return c.rlike(CLEAN)


def canonical_texts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``raw, repaired, key`` for each distinct dirty text in ``texts``.

    ``texts`` has a column ``text``. ``raw`` is the MD5 of the stored text,
    ``key`` that of its consistent form ``repaired``. Clean texts (see CLEAN)
    are their own form and have no row.
    """
    dirty = texts.where(F.col("text").isNotNull() & ~is_clean(F.col("text"))).select(F.md5(F.encode("text", "UTF-8")).alias("raw"), "text").dropDuplicates(["raw"])
    folded = scratch.put(dirty.mapInArrow(_folded, "raw string, folded string, tokens array<string>"), "folded")
    tokens = folded.where(F.size("tokens") > 0).select("raw", F.explode("tokens").alias("token"))
    good = repairs(tokens, vocabulary(texts)).select("token")
    per_text = tokens.join(good, "token").groupBy("raw").agg(F.collect_set("token").alias("good"))
    plain = folded.select("raw", "folded").join(per_text, "raw", "left")
    return scratch.put(plain.mapInArrow(_repaired, "raw string, repaired string, key string"), "canonical")


def consistent_texts(df: DataFrame, text_col: str, vocabulary_from: DataFrame | None = None) -> DataFrame:
    """``df`` with ``text_col`` in one consistent form.

    The vocabulary is that of the column itself, or of ``vocabulary_from``
    (column ``text``). Null stays null; a text of blanks and invisible
    characters becomes empty; all other columns, repeats and row counts stay.
    """
    scratch = Scratch(df.sparkSession, "visual")
    texts = df.select(F.col(text_col).alias("text"))
    canon = canonical_texts(texts if vocabulary_from is None else texts.unionByName(vocabulary_from.select("text")), scratch)
    c = F.col(text_col)
    dirty = c.isNotNull() & ~is_clean(c)
    raw, form = free_name("_raw", df.columns), free_name("_form", df.columns)
    # Only dirty rows are joined; all others, most of a corpus, stay where they are.
    joined = df.where(dirty).withColumn(raw, F.md5(F.encode(c, "UTF-8"))).join(canon.select(F.col("raw").alias(raw), F.col("repaired").alias(form)), raw, "left")
    mended = joined.select(*[F.coalesce(form, text_col).alias(k) if k == text_col else F.col(f"`{k}`") for k in df.columns])
    return df.where(~dirty).unionByName(mended)


def look_alike_classes(texts: DataFrame) -> DataFrame:
    """``space, id, raw, key`` of texts that share a form with a different text.

    ``texts``: ``space, id, text``; ids are compared within a space. Rows with
    null id, null text or no visible character are left out.
    """
    scratch = Scratch(texts.sparkSession, "lookalike")
    canon = canonical_texts(texts.select("text"), scratch)
    t = F.col("text")
    rows = texts.where(F.col("id").isNotNull() & t.isNotNull()).select("space", "id", F.md5(F.encode(t, "UTF-8")).alias("raw"), is_clean(t).alias("clean")).distinct()
    empty = hashlib.md5(b"").hexdigest()
    dirty = rows.where(~F.col("clean")).join(canon.select("raw", "key"), "raw").where(F.col("key") != empty).select("space", "id", "raw", "key")
    dirty = scratch.put(dirty, "dirty")
    clean = rows.where("clean").select("space", "id", "raw", F.col("raw").alias("key"))
    # A clean text can only share its form with a dirty one.
    near = clean.join(dirty.select("space", "key").distinct(), ["space", "key"], "left_semi").select(*dirty.columns)
    members = scratch.put(dirty.unionByName(near), "members")
    several = members.groupBy("space", "key").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("space", "key")
    return members.join(several, ["space", "key"], "left_semi").select("space", "id", "raw", "key")


#: Ids of one spelling that meet in one join key; results don't depend on it.
BLOCK = 1000


def look_alike_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``space, id_a, id_b``: all pairs of ids whose texts look the same but differ.

    Spellings of a form are paired first, then the ids of the two spellings,
    in blocks of about ``block`` ids: rows of equal texts never meet, and no
    join key grows with a form that very many rows share.
    """
    n = members.groupBy("space", "key", "raw").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    other = n.select("space", "key", F.col("raw").alias("raw_b"), F.col("blocks").alias("blocks_b"))
    pairs = n.join(other, ["space", "key"]).where("raw < raw_b")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    met = pairs.withColumn("i", each("blocks")).withColumn("j", each("blocks_b")).drop("blocks", "blocks_b")
    own = members.join(n, ["space", "key", "raw"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    a = own.select("space", "key", "raw", F.col("part").alias("i"), F.col("id").alias("x"))
    b = own.select("space", "key", F.col("raw").alias("raw_b"), F.col("part").alias("j"), F.col("id").alias("y"))
    got = met.join(a, ["space", "key", "raw", "i"]).join(b, ["space", "key", "raw_b", "j"]).where("x <> y")
    return got.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
