"""Evaluation texts leaking into training text.

Items are cut into n-grams (12 words, or 24 characters for items written
without spaces), and a hash set of them goes to every task. Documents are
scanned once: tokens become numbers from the items' own vocabulary (0 for all
others, which no window may contain), windows become 64-bit hashes by twelve
vector operations over the whole batch, and the few hits are verified on the
token numbers themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

_WORDS = re.compile(r"[^\W_]+")
_IDEOGRAPH = re.compile(r"[㐀-鿿豈-﫿𠀀-𯿿]")
WORDS, CHARS = 12, 24
#: Most n-grams sent to the tasks at once (about 100 MB); more items are scanned for in several passes.
BLOCK_GRAMS = 1_000_000
#: Items are collected to the driver; an evaluation set beyond this is refused.
MOST_ITEMS = 2_000_000


def normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).casefold()


class Grams:
    """n-grams of items over a closed vocabulary."""

    def __init__(self, n: int):
        self.n = n
        self.vocab: dict[str, int] = {}
        self.where: dict[tuple[int, ...], set[int]] = defaultdict(set)

    def add(self, item: int, tokens: list[str]) -> None:
        ids = [self.vocab.setdefault(t, len(self.vocab) + 1) for t in tokens]
        for i in range(len(ids) - self.n + 1):
            self.where[tuple(ids[i : i + self.n])].add(item)

    def seal(self) -> None:
        keys = np.array(list(self.where), np.uint64).reshape(-1, self.n)
        self.hashes = np.unique(self.roll(keys.ravel(), self.n)) if len(keys) else np.empty(0, np.uint64)

    def roll(self, ids: np.ndarray, step: int = 1) -> np.ndarray:
        """Hash of the n tokens from each position (every ``step``)."""
        m = (len(ids) - self.n) // step + 1
        h = np.zeros(max(m, 0), np.uint64)
        for k in range(self.n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + (m - 1) * step + 1 : step]
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Positions where an n-gram of an item starts."""
        if len(ids) < self.n or not len(self.hashes):
            return np.empty(0, np.int64)
        # Number of unknown tokens before each position: a window with any is out.
        zeros = np.concatenate([[0], np.cumsum(ids == 0)])
        start = np.flatnonzero(zeros[self.n :] == zeros[: -self.n])
        if not start.size:
            return start
        h = self.roll(ids)[start]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        start = start[self.hashes[at] == h]
        return np.array([p for p in start if tuple(ids[p : p + self.n].tolist()) in self.where], np.int64)


def spaceless(lang: str | None, text: str) -> bool:
    """Items in Chinese, or mostly of ideographs, are compared by character."""
    if lang and lang.strip().lower().startswith("zh"):
        return True
    return not lang and 2 * len(_IDEOGRAPH.findall(text)) > len("".join(_WORDS.findall(text))) > 0


def build(items: list[tuple[int, str | None, str]]) -> tuple[Grams, Grams, bool]:
    """Word and character n-grams, and whether every character n-gram has an
    ideograph (then documents without ideographs need no character scan)."""
    words, chars = Grams(WORDS), Grams(CHARS)
    always = True
    for item, lang, text in items:
        tokens = _WORDS.findall(normal(text))
        if spaceless(lang, text):
            run = "".join(tokens)
            chars.add(item, list(run))
            always &= all(_IDEOGRAPH.search(run, i, i + CHARS) for i in range(len(run) - CHARS + 1))
        else:
            words.add(item, tokens)
    words.seal()
    chars.seal()
    return words, chars, always


def _scan(model: tuple[Grams, Grams, bool], spans: bool):
    words, chars, always = model

    def ids_of(parts: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents' token numbers, apart by zeros, and their starts."""
        gap = [0] * n
        flat: list[int] = []
        starts = np.empty(len(parts), np.int64)
        for k, p in enumerate(parts):
            starts[k] = len(flat)
            flat += p
            flat += gap
        return np.array(flat, np.uint64), starts

    def spans_of(text: str, ids_from, tokens_at, gram: Grams) -> dict[int, list[tuple[int, int]]]:
        ids = np.array(ids_from, np.uint64)
        out: dict[int, list[tuple[int, int]]] = {}
        for p in gram.hits(ids):
            a, z = tokens_at[p][0], tokens_at[p + gram.n - 1][1]
            for item in gram.where[tuple(ids[p : p + gram.n].tolist())]:
                got = out.setdefault(item, [])
                if got and a <= got[-1][1]:
                    got[-1] = (got[-1][0], max(z, got[-1][1]))
                else:
                    got.append((a, z))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wv, cv = words.vocab.get, chars.vocab.get
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                docs, texts = part["doc_id"].to_pylist(), part["text"].to_pylist()
                found: dict[int, set[int]] = defaultdict(set)
                for gram, get in ((words, wv), (chars, cv)):
                    if not len(gram.hashes):
                        continue
                    use = [k for k, t in enumerate(texts) if gram is words or not always or _IDEOGRAPH.search(t)]
                    if gram is words:
                        parts = [[get(w, 0) for w in _WORDS.findall(normal(texts[k]))] for k in use]
                    else:
                        parts = [[get(c, 0) for c in "".join(_WORDS.findall(normal(texts[k])))] for k in use]
                    if not parts:
                        continue
                    ids, starts = ids_of(parts, gram.n)
                    for p in gram.hits(ids):
                        k = use[int(np.searchsorted(starts, p, "right")) - 1]
                        found[k] |= gram.where[tuple(ids[p : p + gram.n].tolist())]
                rows: list[tuple[int, int, int, int]] = []
                for k, items in found.items():
                    if not spans:
                        rows += [(i, docs[k], 0, 0) for i in items]
                        continue
                    text = texts[k]
                    at = [(m.start(), m.end(), normal(m[0])) for m in _WORDS.finditer(text)]
                    got = spans_of(text, [wv(w, 0) for *_, w in at], at, words)
                    single = [(a + j, a + j + 1, normal(c)) for a, z, _ in at for j, c in enumerate(text[a:z])]
                    for i, s in spans_of(text, [cv(c, 0) for *_, c in single], single, chars).items():
                        got.setdefault(i, []).extend(s)
                    rows += [(i, docs[k], a, z) for i, s in got.items() for a, z in s]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["item_id", "doc_id", "start_pos", "end_pos"])

    return run


def leaks(documents: DataFrame, items: DataFrame, spans: bool = False) -> DataFrame:
    """Which documents hold 12 words (or 24 characters) in a row of which item.

    ``documents``: doc_id, text. ``items``: item_id, lang, text, a bounded set
    (see MOST_ITEMS). Result ``item_id, doc_id`` once each, or with ``spans``
    also ``start_pos, end_pos`` of each passage (merged where they overlap).
    Words are runs of letters and digits, whatever stands between them; case
    doesn't count. Null or blank texts and items shorter than an n-gram match
    nothing; repeated rows change nothing; extra columns are ignored.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", "lang", "text").distinct().limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} evaluation items")
    blocks: list[list[tuple]] = [[]]
    size = 0
    for r in sorted(rows, key=lambda r: r[0]):
        size += len(r[2]) // 4
        if size > BLOCK_GRAMS and blocks[-1]:
            blocks.append([])
            size = len(r[2]) // 4
        blocks[-1].append(tuple(r))
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    out = None
    for block in blocks:
        part = docs.mapInArrow(_scan(build(block), spans), "item_id bigint, doc_id bigint, start_pos int, end_pos int")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if spans else out.select("item_id", "doc_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Affected documents without the leaked passages.

    ``doc_id, n_items, n_removed, clean_text``: each passage is cut out and
    replaced by one blank; ``clean_text`` is empty where nothing else remains,
    so the caller can drop the document.
    """
    found = leaks(documents, items, spans=True)
    cuts = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("cuts"), F.count_distinct("item_id").alias("n_items"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, removed = [], []
            for text, spans in zip(b["text"].to_pylist(), b["cuts"].to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                for s in spans:
                    a, z = max(at, s["start_pos"]), s["end_pos"]
                    if z > a:
                        kept.append(text[at:a])
                        n += z - a
                        at = z
                kept.append(text[at:])
                out.append(" ".join(x.strip() for x in kept if x.strip()))
                removed.append(n)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_items"], pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_items", "n_removed", "clean_text"])

    both = documents.select("doc_id", "text").join(cuts, "doc_id").select("doc_id", "n_items", "text", "cuts")
    return both.mapInArrow(cut, "doc_id bigint, n_items bigint, n_removed bigint, clean_text string")
