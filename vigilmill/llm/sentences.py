"""Sentence units across languages and scripts.

A linear-chain model tags characters as boundary (the unit ends here) or
inside. Only some characters can be boundaries: the last of a run of sentence
punctuation with the marks that close it, a line break, and a blank next to a
letter of a script without sentence punctuation; all others are inside and
pass the chain unchanged, so Viterbi runs over the candidates alone. Weights
come from a structured perceptron on texts composed of hand-labelled units
(sentence_seeds): their boundaries are known by construction, with blanks,
line breaks, wrapped lines, lists and headings put between them, and with the
punctuation stripped for scripts that have none.
"""

from __future__ import annotations

import json
import os
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .sentence_seeds import ABBREVIATIONS, BEFORE_LETTER, NUMBER_ABBREVIATIONS, ORDINAL_BEFORE, SEEDS, TITLES

MODEL = os.path.join(os.path.dirname(__file__), "models", "boundary_tagger.json")
TERMINATORS = ".!?…。！？．｡।॥؟۔"
# Opening marks and what closes them.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "《": "》"}
_CLOSING = "”“»「」』’)）]】›》\"'‘"
_BARE = "\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f"
_EVENT = re.compile(rf"[{re.escape(TERMINATORS)}]+|\s*\n\s*|[“”„«»「」『』‘’‚()（）\[\]【】‹›《》\"']|(?<=[{_BARE}])[^\S\n]+|[^\S\n]+(?=[{_BARE}])")
_BARE_CHAR = re.compile(f"[{_BARE}]")
_BLANK = re.compile(r"\s*")
_MARK = re.compile(r"[^\S\n]*(?:([-*•‣◦–—·▪])|(\d{1,3})[.)]|([a-zA-Z])[)])[^\S\n]+")
_WORD_BEFORE = re.compile(r"[^\s(\[“„«\"'‘、-〗぀-ヿ㐀-鿿！-･]*$")
_QUOTATIVE = re.compile("と(?:思|言|い[うっわ]|聞|考|感|書|述|伝|答|話|、)")
_ABBR = frozenset(a.casefold() for a in ABBREVIATIONS)
_TITLE = frozenset(a.casefold() for a in TITLES)
_NUMBER = frozenset(a.casefold() for a in NUMBER_ABBREVIATIONS)
_ORDINAL = frozenset(ORDINAL_BEFORE)
_LETTER = frozenset(BEFORE_LETTER)


def _kind_of_next(text: str, at: int) -> str:
    """What follows position ``at`` (not a blank)."""
    if at >= len(text):
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c == "と" and _QUOTATIVE.match(text, at):
        return "quotative"
    if c.isalpha():
        if c.islower():
            m = re.compile(r"[^\W\d_]*").match(text, at)
            return "mixed" if any(x.isupper() for x in m[0]) or text[at + 1 : at + 2] == "-" and text[at + 2 : at + 3].isupper() else "lower"
        if c.isupper() or unicodedata.category(c) == "Lt":
            return "upper"
        return "uncased"
    if c in ".!?…":
        return "joins"
    if c in "\"'“„«‘‚(（[「『【¿¡‹《":
        return "open"
    if c in ",;:，、；：،)]）】」』”’»-–—/%":
        return "joins"
    if "\u0900" <= c <= "\u0dff":
        return "uncased"
    return "other"


def _kind_of_word(text: str, start: int, end: int) -> str:
    """The class of the word before a full stop at ``end``."""
    word = _WORD_BEFORE.search(text, max(start, end - 40), end)[0]
    w = word.casefold()
    if not w:
        return "none"
    if w in _TITLE or (w.rpartition(".")[0][-2:].isalpha() and w.rpartition(".")[2] in _TITLE):
        return "title"
    if w in _NUMBER or (w.rpartition(".")[0][-2:].isalpha() and w.rpartition(".")[2] in _NUMBER):
        return "number-abbr"
    if w in _ABBR:
        return "abbr"
    if len(w) == 1 and w.isalpha():
        before = re.search(r"(\S+)\s+$", text[max(0, end - 32) : end - 1])
        if before and before[1].casefold() in _LETTER:
            return "word"
        return "initial" if word.isupper() else "letter"
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", w):
        return "clock" if w in ("a.m", "p.m") else "dotted"
    if w.isdigit() and len(w) <= 2:
        before = re.search(r"(\S+)\s+$", text[max(0, end - 32) : end - len(w)])
        if before and before[1].casefold() in _ORDINAL:
            return "ordinal"
    return "digits" if w[-1].isdigit() else "word"


def candidates(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """Positions that may end a unit, each with its features."""
    out: list[tuple[int, tuple[str, ...]]] = []
    stack: list[tuple[str, bool]] = []
    line_start, in_list, last_number = 0, False, 0
    fresh = True  # the line starts a paragraph or follows a finished unit
    skip = 0
    marker_end = 0

    def start_line(at: int, free: bool) -> bool:
        nonlocal in_list, last_number, marker_end, line_start
        line_start = at
        m = _MARK.match(text, at)
        ok = bool(m) and (free or in_list)
        if ok and m[2]:
            n = int(m[2])
            ok = n == 1 or (in_list and n == last_number + 1)
            last_number = n if ok else 0
        elif not ok:
            last_number = 0
        in_list, marker_end = ok, m.end() if ok else at
        return ok

    start_line(0, True)
    for m in _EVENT.finditer(text):
        s, e = m.span()
        if s < skip:
            continue
        c = text[s]
        if c in TERMINATORS:
            if e <= marker_end:
                continue
            depth = len(stack)
            closed = ""
            at = e
            while at < len(text):
                x = text[at]
                step = at
                if x in " \u00a0\u202f" and text[at + 1 : at + 2] in ("»", "›"):
                    step, x = at + 1, text[at + 1]
                if stack and x in PAIRS.get(stack[-1][0], stack[-1][0]):
                    opener, at_start = stack.pop()
                    closed = ("round" if opener in "(（[【" else "quote") + ("-start" if at_start else "-mid")
                    at = step + 1
                elif x in "”»」』)）]】" and x not in "»" and step == at:
                    at += 1
                else:
                    break
            skip = at
            follow = _BLANK.match(text, at).end()
            space = "para" if text.count("\n", at, follow) > 1 else "line" if "\n" in text[at:follow] else "blank" if follow > at else "tight"
            kind = "ellipsis" if c == "…" or text[s:e].startswith("..") else "dot" if text[s:e] == "." else "wide" if c in "。！？．｡" else "danda" if c in "।॥۔" else "strong"
            word = _kind_of_word(text, line_start if line_start < s else 0, s) if kind == "dot" else "-"
            nxt = "end" if follow >= len(text) else _kind_of_next(text, follow)
            if space == "line" and _MARK.match(text, follow):
                nxt = "list"
            inside = "in" if stack else "out"
            cased = "cased" if nxt in ("upper", "lower", "mixed") else "flat"
            out.append((at, (f"k={kind}", f"k={kind} s={space}", f"k={kind} n={nxt}", f"w={word} n={nxt}", f"w={word} s={space}", f"in={inside}", f"c={closed} n={nxt}", f"c={closed} s={space} {cased}", f"k={kind} w={word} s={space} n={nxt} in={inside} c={closed}", f"d={min(depth, 2)} in={inside}")))
            fresh = True
        elif "\n" in m[0]:
            para = m[0].count("\n") > 1
            before = text[s - 1] if s else ""
            ended = text[max(0, s - 8) : s].rstrip(_CLOSING + " \u00a0\u202f")[-1:] in TERMINATORS if s else False
            was = in_list
            bare_end = bool(_BARE_CHAR.search(text, max(line_start, s - 24), s))
            is_list = start_line(e, para or ended or bare_end or before in ":：")
            nxt = "list" if is_list else _kind_of_next(text, e)
            thai = bare_end or bool(_BARE_CHAR.match(text, e))
            if para:
                stack.clear()
            shape = "para" if para else "line"
            if para or is_list or not ended:  # else the punctuation before it decides
                out.append((s, (f"b={shape}", f"b={shape} list={is_list}{was}", f"b={shape} end={ended}", f"b={shape} bare={thai}", f"b={shape} n={nxt} list={is_list}{was} end={ended} bare={thai} in={'in' if stack else 'out'}")))
            fresh = True
        elif c.isspace():
            out.append((s, ("b=bare",)))
            fresh = True
        else:
            if stack and c in PAIRS.get(stack[-1][0], stack[-1][0]) and not (c == "'" and text[e : e + 1].isalpha()):
                stack.pop()
            elif c in PAIRS or c in "\"'":
                before = text[s - 1] if s else " "
                if c == "'" and (not before.isspace() and before not in "(\"“„«" or not text[e : e + 1].isalpha()):
                    continue
                if c in "’‘" and before.isalpha():
                    continue
                if c == "»" and not any(o == "»" for o, _ in stack) and before.isspace() and not text[e : e + 1].isalpha():
                    continue
                prior = text[:s].rstrip()[-1:] if s < 200 else text[s - 200 : s].rstrip()[-1:]
                stack.append((c, fresh or prior == "" or prior in TERMINATORS or prior in "”」』)）》" or s == marker_end))
            fresh = False
            continue
        fresh = False  # it holds only until something visible follows
    return out


class BoundaryTagger:
    """Two tags, feature weights for ``boundary`` and tag transitions."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.t = [[0.0, 0.0], [0.0, 0.0]]
        self._memo: dict[tuple[str, ...], float] = {}

    def emission(self, f: tuple[str, ...]) -> float:
        got = self._memo.get(f)
        if got is None:
            got = self._memo[f] = sum(self.w.get(x, 0.0) for x in f)
        return got

    def decode(self, feats: list[tuple[str, ...]]) -> list[int]:
        """The best tag sequence (Viterbi)."""
        if not feats:
            return []
        t = self.t
        back: list[tuple[int, int]] = []
        inside, bound = 0.0, self.emission(feats[0])
        for f in feats[1:]:
            e = self.emission(f)
            i0, i1, b0, b1 = inside + t[0][0], bound + t[1][0], inside + t[0][1], bound + t[1][1]
            back.append((int(i1 > i0), int(b1 > b0)))
            inside, bound = max(i0, i1), max(b0, b1) + e
        tag = int(bound > inside)
        tags = [tag]
        for b in reversed(back):
            tag = b[tag]
            tags.append(tag)
        return tags[::-1]

    def train(self, data: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 8, seed: int = 5) -> BoundaryTagger:
        """Averaged structured perceptron."""
        w, total = defaultdict(float), defaultdict(float)
        t, tt, n = [[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]], 0
        rng = random.Random(seed)
        order = list(range(len(data)))
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                feats, gold = data[k]
                self.w, self.t, self._memo = w, t, {}
                got = self.decode(feats)
                n += 1
                if got == gold:
                    continue
                for f, g, h in zip(feats, gold, got, strict=True):
                    if g != h:
                        for x in f:
                            w[x] += g - h
                            total[x] += n * (g - h)
                for (g0, g1), (h0, h1) in zip(zip(gold, gold[1:]), zip(got, got[1:]), strict=True):
                    t[g0][g1] += 1
                    tt[g0][g1] += n
                    t[h0][h1] -= 1
                    tt[h0][h1] -= n
        self.w = {k: v - total[k] / (n + 1) for k, v in w.items()}
        self.t = [[t[i][j] - tt[i][j] / (n + 1) for j in (0, 1)] for i in (0, 1)]
        self._memo = {}
        return self


def compose(rng: random.Random, seeds: dict[str, list[str]], lang: str) -> tuple[str, list[int]]:
    """A text of labelled units, and the positions where they end."""
    tight = lang in ("zh", "ja")
    parts: list[str] = []
    ends: list[int] = []
    at = 0

    def put(s: str, end: bool) -> None:
        nonlocal at
        parts.append(s)
        at += len(s)
        if end:
            ends.append(at)

    width = rng.choice([0, 40, 60]) if not tight and lang != "th" else 0
    for p in range(rng.randint(1, 4)):
        if p:
            put("\n\n", False)
        what = rng.random()
        if what < 0.15 and "heading" in seeds:
            put(rng.choice(seeds["heading"]), True)
            continue
        units = [rng.choice(seeds[lang]) for _ in range(rng.randint(1, 7))]
        column = 0
        for k, u in enumerate(units):
            if k:
                sep = "" if tight and rng.random() < 0.9 else rng.choice([" ", " ", " ", " ", "  ", "\n"])
                put(sep, False)
                column = 0 if sep == "\n" else column + len(sep)
            if width:
                out = []
                for x in u.split(" "):
                    if column + len(x) > width and column:
                        out.append("\n" + x)
                        column = len(x)
                    else:
                        out.append((" " if out else "") + x)
                        column += len(x) + 1
                u = "".join(out) if not out[0].startswith("\n") else "".join(out)[1:]
            put(u, True)
        if rng.random() < 0.25 and "item" in seeds:
            mark = rng.choice(["- ", "* ", "• ", "#"])
            put("\n", False)
            for k in range(rng.randint(2, 5)):
                if k:
                    put("\n", False)
                put((f"{k + 1}. " if mark == "#" else mark) + rng.choice(seeds["item"]), True)
    return "".join(parts), ends


def labelled(text: str, ends: list[int]) -> tuple[list[tuple[str, ...]], list[int]]:
    """Candidates' features with gold tags: the first candidate at or after
    the last visible character of a unit ends it."""
    cand = candidates(text)
    want = set(ends)
    return [f for _, f in cand], [int(p in want or len(text[:p].rstrip()) in want and p > len(text[:p].rstrip())) for p, _ in cand]


def trained_tagger(seeds: dict[str, list[str]] = SEEDS, texts: int = 3000, seed: int = 11) -> BoundaryTagger:
    """A tagger from ``texts`` composed texts; takes seconds, same every time."""
    rng = random.Random(seed)
    langs = sorted(k for k in seeds if k not in ("heading", "item"))
    return BoundaryTagger().train([labelled(*compose(rng, seeds, langs[k % len(langs)])) for k in range(texts)])


def save_tagger(tagger: BoundaryTagger, path: str = MODEL) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"w": {k: round(v, 4) for k, v in sorted(tagger.w.items()) if v}, "t": tagger.t}, f, ensure_ascii=False, indent=0)


def stored_tagger(path: str = MODEL) -> BoundaryTagger:
    """The tagger that ``python -m vigilmill.llm.sentences`` trained and stored."""
    out = BoundaryTagger()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    out.w, out.t = data["w"], data["t"]
    return out


def split_units(text: str, tagger: BoundaryTagger) -> list[tuple[int, int]]:
    """Spans of the units: no blanks at their ends, all visible text covered."""
    cand = candidates(text)
    tags = tagger.decode([f for _, f in cand])
    out, start = [], 0
    for end in [p for (p, _), g in zip(cand, tags, strict=True) if g] + [len(text)]:
        if end <= start:
            continue
        a, z = start, end
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if z > a:
            out.append((a, z))
        start = end
    return out


def _split(model: tuple[dict[str, float], list[list[float]]], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = BoundaryTagger()
        tagger.w, tagger.t = model
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows, starts, ends, seqs, units = [], [], [], [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    spans = split_units(text, tagger)
                    rows += [k] * len(spans)
                    starts += [a for a, _ in spans]
                    ends += [z for _, z in spans]
                    seqs += range(len(spans))
                    if with_text:
                        units += [text[a:z] for a, z in spans]
                keys = [part[c].take(pa.array(rows, pa.int64())) for c in part.schema.names if c != "text"]
                cols = [*keys, pa.array(seqs, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *([pa.array(units, pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(cols, [*[c for c in part.schema.names if c != "text"], "unit_no", "start_pos", "end_pos", *(["unit"] if with_text else [])])

    return run


def sentence_units(documents: DataFrame, tagger: BoundaryTagger | None = None, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, unit_no, start_pos, end_pos`` for every unit of every document.

    ``keep`` names columns that each unit takes along, ``with_text`` adds
    ``unit``, its text, in the same pass. Positions are code points, the end
    exclusive. Null, empty and blank texts have no units; repeated rows repeat
    their units; a text of any length is one pass in one task, with memory in
    proportion to it; other columns are ignored.
    """
    tagger = tagger or stored_tagger()
    keys = ["doc_id", *keep]
    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, unit_no int, start_pos int, end_pos int" + (", unit string" if with_text else "")
    return spread(documents.where("text is not null").select(*keys, "text")).mapInArrow(_split((tagger.w, tagger.t), with_text), schema)


if __name__ == "__main__":
    save_tagger(trained_tagger())
