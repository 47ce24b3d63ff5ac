"""Personal information inside free text: find it, replace it by placeholders.

A character-level bidirectional LSTM scores each character for each tag, and a
CRF picks the best tag sequence. Text is first folded character by character
(full-width digits, look-alike letters, accents; invisible characters drop
out), with a map back to stored positions. Every text is decoded as a whole: a
name may stand in any letters, case and script, so no part of a text can be
left out. Texts of up to WHOLE characters are scored in one pass, many side by
side in lanes; longer ones are covered by overlapping windows whose scores are
blended. One Viterbi pass over the whole text gives its tags, run only where a
bound lets a tag pay. Found spans are then
snapped to token edges and checked for form (a phone has seven digits, a name
two words, and so on).
"""

from __future__ import annotations

import ctypes
import glob
import heapq
import multiprocessing
import os
import random
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .visual import LOOKALIKE, _fold_char

TYPES = ["name", "phone", "id_number", "email", "address"]
TAGS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
WINDOW, STRIDE, BATCH = 224, 192, 512
EMBED, HIDDEN = 16, 24
#: Characters decoded at once; these only bound memory.
CELLS, PART = 400_000, 1_000_000
#: Characters the model tells apart: printable ASCII, line feed, other small (or caseless) letters, other capitals,
#: letters of unspaced scripts, frequent Chinese and Japanese family names, everything else.
VOCAB = 101
#: Codes of cells between texts, in leads(): TAIL cells behind a text's end, which are read as any other character, and one or more that clear the state.
END, PAD, TAIL = VOCAB, VOCAB + 1, 3
#: Characters of a text that is scored in one pass; longer ones are covered by windows.
WHOLE = 2048
#: Lanes of a block, whose products fit the caches, and blocks that share a step's calls.
LANES, BLOCKS = 160, 4
MODEL = os.path.join(os.path.dirname(__file__), "models", "pii_tagger.npz")

# Letters without a canonical decomposition, by their plain form.
_PLAIN = {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "þ": "th", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "⁄": "/", "，": ",", "．": "."}
# Titles, which are no part of a name.
_TITLE = re.compile(r"(?i:dr|mr|mrs|ms|prof|herr|frau|dra|mme)(?:\. ?| )")
_MAIL = re.compile(r"@|[(\[] ?at ?[)\]]| at (?=[\w.-]+ ?[(\[]?dot)")
_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d")
_STREET_WORD = r"rue|avenue|av\.|boulevard|bd|chemin|place|allee|quai|impasse|route"
#: Surfaces that are almost certainly personal; texts with one are no background for training.
_SURE = re.compile(rf"\d,? (?:{_STREET_WORD}) |(?i:strasse|weg|gasse|platz|allee|str\.) \d|(?<!\w)(?i:calle|c/|avenida|avda\.?|plaza|paseo|camino) |\d[a-c]? (?:Old )?[A-Z][a-z]+ (?:Street|St\.?|Road|Rd\.?|Ave|Avenue|Lane|Drive|Close|Court|Terrace|Blvd)|555|7700|23125|99 ?00|\b999[ -]|\b9\d\d[ -]\d\d[ -]\d{{4}}|QQ|\b[XYZ][ -]?\d{{7}}|(?<![\dX])\d{{8,}}")


# Characters that Chinese and Japanese family names often start with.
_FAMILY = frozenset("王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾肖田董袁潘蒋蔡余杜叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔钟鍾谭陆陸范汪石廖贾夏韦傅方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔汤佐藤鈴木高橋渡辺伊山中村小加吉佐々")


#: Letters of scripts without blanks between words: Thai to Khmer, kana, ideographs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Folds(dict):
    """What a character is to the model; fills itself."""

    def __missing__(self, key: int) -> str:
        c = _fold_char(chr(key))
        c = "".join(LOOKALIKE.get(x, x) for x in c)
        c = "".join(_PLAIN.get(x, x) for x in c)
        c = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if c and not c.isascii():
            c = "".join(x if x.isascii() else "\x02" if not x.isalpha() else "\x05" if x in _FAMILY else "\x03" if _UNSPACED.match(x) else "\x04" if x.isupper() else "\x01" for x in c)
        self[key] = c
        return c


def positions(text: str, table: Folds) -> np.ndarray | None:
    """The stored position of each character of the model's view (None: the same)."""
    return None if text.isascii() else np.repeat(np.arange(len(text)), [len(table[ord(c)]) for c in text])


def folded(text: str, table: Folds) -> tuple[str, np.ndarray | None]:
    """The model's view of ``text``, and each character's stored position
    (None: the same)."""
    return text if text.isascii() else text.translate(table), positions(text, table)


_CODE = np.full(256, 97, np.uint8)
for _c in range(32, 127):
    _CODE[_c] = _c - 32
_CODE[10] = 95
_CODE[[1, 3, 4, 5]] = [96, 98, 99, 100]
_CODE[2] = 97


def codes(view: str) -> np.ndarray:
    return _CODE[np.frombuffer(view.encode("latin-1", "replace"), np.uint8)]


def one_thread() -> None:
    """Keep numpy's matrix products in this task's own thread: the products
    are small, and a pool of threads per task would only spin."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for f in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, f):
                getattr(lib, f)(1)
                return


class Tagger:
    """BiLSTM scores and CRF transitions, in numpy.

    Arrays are (time, unit, sequence), so each gate of a step is one
    contiguous block; the gates stand in the order in, forget, out, new.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        k, h, e = len(TAGS), hidden, EMBED
        u = lambda *s: (r.uniform(-1, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (r.normal(0, 0.3, (VOCAB, e))).astype(np.float32), "O": u(2 * h, k), "c": np.zeros(k, np.float32), "T": np.zeros((k, k), np.float32), "S": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": u(e, 4 * h), f"U{d}": u(h, 4 * h), f"B{d}": np.zeros(4 * h, np.float32)}
            self.p[f"B{d}"][h : 2 * h] = 1.0
        self.h = hidden
        #: Memory that leads() writes to, kept because fresh pages cost time.
        self.room = np.empty(0, np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (T, B) codes, in reading order of the direction; (T, h, B)."""
        p, h = self.p, self.h
        # sigmoid(z) = (tanh(z / 2) + 1) / 2: halving is done once, in the weights.
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], p["E"].dtype), h)[:, None]
        table = np.ascontiguousarray((p["E"] @ p[f"W{d}"] + p[f"B{d}"]).T * half)
        u = np.ascontiguousarray(p[f"U{d}"].T * half)
        t, b = x.shape
        kind = table.dtype
        hs, c, hid = np.empty((t, h, b), kind), np.zeros((h, b), kind), np.zeros((h, b), kind)
        g, e = np.empty((4 * h, b), kind), np.empty((4 * h, b), kind)
        tc = np.empty((h, b), kind)
        for s in range(t):
            if keep is not None:
                g, tc, before = np.empty((4 * h, b), kind), np.empty((h, b), kind), c.copy()
            np.matmul(u, hid, out=g)
            np.take(table, x[s], axis=1, out=e, mode="clip")
            g += e
            np.tanh(g, out=g)
            a = g[: 3 * h]
            a *= 0.5
            a += 0.5
            c *= g[h : 2 * h]
            c += g[:h] * g[3 * h :]
            np.tanh(c, out=tc)
            prior, hid = hid, hs[s]
            np.multiply(g[2 * h : 3 * h], tc, out=hid)
            if keep is not None:
                keep.append((g, before, tc, prior))
        return hs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(T, B) codes to (T, tags, B)."""
        o, h = self.p["O"].T, self.h
        out = np.ascontiguousarray(o[:, :h]) @ self._lstm(x, "f")
        out += np.ascontiguousarray(o[:, h:]) @ self._lstm(x[::-1], "b")[::-1]
        out += self.p["c"][:, None]
        return out

    # Training: exact gradients of the CRF's log-likelihood.

    def step(self, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for codes, tags and mask, each (T, B)."""
        p, h = self.p, self.h
        t, b = x.shape
        kf: list = []
        kb: list = []
        both = np.concatenate([self._lstm(x, "f", kf), self._lstm(x[::-1], "b", kb)[::-1]], 1)
        e = (p["O"].T @ both + p["c"][:, None]).astype(np.float64)
        k, tr = e.shape[1], p["T"].astype(np.float64)
        move, top = np.exp(tr - tr.max()), e.max(1, keepdims=True)
        ee = np.exp(e - top)
        # Forward and backward sums, scaled to 1 at each step; masked steps change nothing.
        alpha, beta, z = np.empty_like(e), np.ones_like(e), np.ones((t, b))
        alpha[0] = ee[0] * np.exp(p["S"].astype(np.float64))[:, None]
        z[0] = alpha[0].sum(0)
        alpha[0] /= z[0]
        for s in range(1, t):
            a = move.T @ alpha[s - 1] * ee[s]
            total = a.sum(0)
            z[s] = np.where(m[s], total, 1)
            alpha[s] = np.where(m[s], a / total, alpha[s - 1])
        pair = np.zeros((k, k))
        for s in range(t - 1, 0, -1):
            w = ee[s] * beta[s] / z[s]
            pair += (alpha[s - 1] * m[s]) @ w.T
            beta[s - 1] = np.where(m[s], move @ w, beta[s])
        marg = alpha * beta * m[:, None, :]
        logz = ((np.log(z) + top[:, 0] + tr.max()) * m).sum(0) - tr.max()
        bi = np.arange(b)
        on = m[1:]
        gold = p["S"][y[0]] + e[0, y[0], bi]
        gold = gold + np.where(on, tr[y[:-1], y[1:]] + np.take_along_axis(e[1:], y[1:, None, :], 1)[:, 0], 0).sum(0)
        loss = float((logz - gold).mean())
        de = marg.copy()
        np.put_along_axis(de, y[:, None, :], np.take_along_axis(de, y[:, None, :], 1) - m[:, None, :], 1)
        ds = marg[0].sum(1) - np.bincount(y[0], minlength=k)
        dtr = pair * move - np.bincount((y[:-1] * k + y[1:])[on], minlength=k * k).reshape(k, k)
        de = (de / b).astype(both.dtype)
        g = {"O": np.einsum("thb,tkb->hk", both, de, optimize=True), "c": de.sum((0, 2)), "T": (dtr / b).astype(both.dtype), "S": (ds / b).astype(both.dtype), "E": np.zeros_like(p["E"])}
        dboth = p["O"] @ de
        for d, keep, dh_all, xs in (("f", kf, dboth[:, :h], x), ("b", kb, dboth[::-1, h:], x[::-1])):
            u = p[f"U{d}"]
            du, every = np.zeros((4 * h, h), both.dtype), np.empty((t, 4 * h, b), both.dtype)
            dh, dc = np.zeros((h, b), both.dtype), np.zeros((h, b), both.dtype)
            for s in range(t - 1, -1, -1):
                q, before, tc, prior = keep[s]
                i, fg, o, n = q[:h], q[h : 2 * h], q[2 * h : 3 * h], q[3 * h :]
                dh = dh + dh_all[s]
                dc = dc + dh * o * (1 - tc * tc)
                dg = every[s]
                dg[:h], dg[h : 2 * h], dg[2 * h : 3 * h], dg[3 * h :] = dc * n * i * (1 - i), dc * before * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - n * n)
                du += dg @ prior.T
                dh, dc = u @ dg, dc * fg
            seen = np.zeros((t * b, VOCAB), both.dtype)
            seen[np.arange(t * b), xs.ravel()] = 1
            dgx = seen.T @ every.transpose(0, 2, 1).reshape(t * b, 4 * h)
            g[f"U{d}"], g[f"W{d}"], g[f"B{d}"] = du.T, p["E"].T @ dgx, dgx.sum(0)
            g["E"] += dgx @ p[f"W{d}"].T
        return loss, g

    def fit(self, shards: list[Callable[[int], list[tuple[np.ndarray, np.ndarray]]]], steps: int, rate: float = 4e-3, report=None) -> Tagger:
        """Adam; each step sums the gradients of one batch a shard.

        A shard makes its batch of windows (codes, tags) for a step number.
        Several shards run in processes of their own, one a shard.
        """
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        pipes, crew = [], []
        if len(shards) > 1:
            ctx = multiprocessing.get_context("fork")
            for s in shards:
                here, there = ctx.Pipe()
                w = ctx.Process(target=_serve, args=(self.h, s, there), daemon=True)
                w.start()
                pipes.append(here)
                crew.append(w)
        losses: list[float] = []
        for n in range(1, steps + 1):
            if pipes:
                for q in pipes:
                    q.send((n, self.p))
                got = [q.recv() for q in pipes]
            else:
                got = [self.step(*padded(shards[0](n)))]
            losses.append(sum(x[0] for x in got) / len(got))
            grad = {k: sum(x[1][k] for x in got) / len(got) for k in self.p}
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            lr = rate * min(1.0, n / 40) * (1 - 0.95 * n / steps)
            for k, v in grad.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
            if report and (n % 100 == 0 or n == steps):
                report(n, float(np.mean(losses[-100:])))
        for q, w in zip(pipes, crew, strict=True):
            q.send(None)
            w.join()
        self.losses = losses
        return self

    def save(self, path: str = MODEL) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str = MODEL) -> Tagger:
        with np.load(path) as z:
            got = {k: z[k].astype(np.float32) for k in z.files}
        out = cls(got["Uf"].shape[0])
        out.p = got
        return out

    # Decoding.

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """What leads() multiplies by: one matrix a direction, of the gates and
        of every tag's lead over O (B tags first, with what Runs adds), for
        (state, 1, embedding, pad); and a row of (embedding, pad) a code.

        Rows of in, forget and out are halved (see _lstm). States come doubled,
        so columns of the state are halved. PAD shuts all three, which leaves a
        state of exactly zero.
        """
        p, h, k = self.p, self.h, len(TAGS) - 1
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], p["E"].dtype), h)[:, None]
        w = np.zeros((2, 1, 4 * h + k, h + 2 + EMBED), p["E"].dtype)
        tags = np.r_[1 : k + 1 : 2, 2 : k + 1 : 2]
        lead = p["O"][:, tags] - p["O"][:, :1]
        for n, d in enumerate("fb"):
            w[n, 0, : 4 * h, :h] = p[f"U{d}"].T * half * 0.5
            w[n, 0, : 4 * h, h] = p[f"B{d}"] * half[:, 0]
            w[n, 0, : 4 * h, h + 1 : -1] = p[f"W{d}"].T * half
            w[n, 0, : 3 * h, -1] = -1e3
            w[n, 0, 4 * h :, :h] = lead[n * h : (n + 1) * h].T * 0.5
        w[0, 0, 4 * h :, h] = p["c"][tags] - p["c"][0] + Runs(self).added
        rows = np.zeros((VOCAB + 2, EMBED + 1), p["E"].dtype)
        rows[:VOCAB, :-1] = p["E"]
        rows[END, :-1] = p["E"][97]
        rows[PAD, -1] = 1
        # By columns, which multiplies faster.
        return np.ascontiguousarray(w.swapaxes(2, 3)).swapaxes(2, 3), rows

    def leads(self, x: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores over that of O, of lanes of codes: (step, block, lane) to
        (step, tag but O, block, lane); w and rows as from joined(). The next
        call overwrites the result.

        Both directions run at once. A step's product also has the leads of
        the step before, so there is one step more than cells.
        """
        h, (t, n, b) = self.h, x.shape
        kind, k, width = w.dtype, len(TAGS) - 1, rows.shape[1]
        on, g = np.zeros((2, n, w.shape[-1], b), kind), np.empty((2, n, 4 * h + k, b), kind)
        on[:, :, h] = 1
        c, r, e = np.zeros((2, n, h, b), kind), np.empty((2, n, h, b), kind), np.empty((2, n, b, width), kind)
        gates, shut, new, lead = g[:, :, : 4 * h], g[:, :, : 3 * h], g[:, :, 3 * h : 4 * h], g[:, :, 4 * h :].swapaxes(1, 2)
        enter, keep, show = g[:, :, :h], g[:, :, h : 2 * h], g[:, :, 2 * h : 3 * h]
        state, seen, turned = on[:, :, :h], on[:, :, h + 1 :], e.transpose(0, 1, 3, 2)
        both = np.empty((2, n, b), np.intp)
        if self.room.size < t * k * n * b or self.room.dtype != kind:
            self.room = np.empty(t * k * n * b, kind)
        out = self.room[: t * k * n * b].reshape(t, k, n, b)
        for s in range(t + 1):
            if s < t:
                both[0], both[1] = x[s], x[t - 1 - s]
                np.take(rows, both, axis=0, out=e, mode="clip")
                seen[...] = turned
            np.matmul(w, on, out=g)
            if s:
                # Each cell is met twice: set the first time, added the second.
                there, back = s - 1, t - s
                if there <= back:
                    out[there] = lead[0]
                else:
                    out[there] += lead[0]
                if there < back:
                    out[back] = lead[1]
                else:
                    out[back] += lead[1]
            np.tanh(gates, out=gates)
            np.add(shut, 1, out=shut)
            np.multiply(c, keep, out=c)
            np.multiply(enter, new, out=r)
            np.add(c, r, out=c)
            np.multiply(c, 0.5, out=c)
            np.tanh(c, out=r)
            np.multiply(show, r, out=state)
        return out

    def emissions(self, view: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Scores of stretches over that of O, and which characters may get a
        tag.

        ``view`` holds the stretches' codes one after the other, ``sizes``
        their lengths. Every stretch is scored, those of up to WHOLE characters
        in one pass, others by overlapping windows whose scores are blended.
        Only those stretches come out in which some character may get a tag.
        What is scored along with a stretch changes nothing.
        """
        starts = np.cumsum(sizes) - sizes
        many = np.where(sizes <= WHOLE, 1, -((WINDOW - sizes) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(sizes)), many)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        size = np.where(many[owner] > 1, np.minimum(sizes[owner] - at, WINDOW), sizes[owner])
        w, rows = self.joined()
        runs = Runs(self)
        open_ = many > 1
        got: dict[int, np.ndarray] = {}
        pay_at: dict[int, np.ndarray] = {}
        # Pieces stand in lanes one after the other, the longest first, each with END (if it has the text's end) and PAD behind it.
        upto = np.cumsum(size + TAIL + 1)
        group = (upto - 1) // (-(-upto[-1] // -(-upto[-1] // PART)))
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
            part = part[np.argsort(-size[part], kind="stable")]
            need = int((size[part] + TAIL + 1).sum())
            lanes = int(min(LANES * BLOCKS, len(part), -(-need // (size[part[0]] + TAIL + 1))))
            blocks = -(-lanes // LANES)
            width = -(-lanes // blocks)
            fill = [(0, j) for j in range(blocks * width)]
            lane, place = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for j, n in enumerate(size[part].tolist()):
                used, lane[j] = fill[0]
                place[j] = used
                heapq.heapreplace(fill, (used + n + TAIL + 1, int(lane[j])))
            t = max(fill)[0]
            cells = np.full((blocks * width, t), PAD, np.uint8)
            for ln, a, n, v in zip(lane.tolist(), place.tolist(), size[part].tolist(), (starts[owner[part]] + at[part]).tolist(), strict=True):
                cells[ln, a : a + n] = view[v : v + n]
            ends = at[part] + size[part] == sizes[owner[part]]
            for j in range(TAIL):
                cells[lane[ends], place[ends] + size[part][ends] + j] = END
            x = np.ascontiguousarray(cells.T).reshape(t, blocks, width)
            sc = self.leads(x, w, rows).reshape(t, len(TAGS) - 1, -1)
            hot = runs.pay(sc, x.reshape(t, -1) >= VOCAB, place, place + size[part] - 1, lane).T.ravel()
            flat = lane * t + place
            by = np.argsort(flat)
            pays = np.empty(len(part), bool)
            pays[by] = np.logical_or.reduceat(hot, flat[by])
            open_[owner[part[pays]]] = True
            for j in np.flatnonzero(pays | (many[owner[part]] > 1)):
                got[int(part[j])] = sc[place[j] : place[j] + size[part[j]], :, lane[j]] - runs.added
                pay_at[int(part[j])] = hot[flat[j] : flat[j] + size[part[j]]]
        opened = np.flatnonzero(open_)
        if not opened.size:
            return {}
        ends = np.cumsum(sizes[opened])
        begins = ends - sizes[opened]
        total, hot = np.zeros((ends[-1], len(TAGS)), np.float32), np.ones(ends[-1], bool)
        first = np.cumsum(many) - many
        for k, o in zip(opened, begins, strict=True):
            n, p = int(sizes[k]), int(first[k])
            if many[k] == 1:
                total[o : o + n, 1::2], total[o : o + n, 2::2], hot[o : o + n] = got[p][:, : len(TYPES)], got[p][:, len(TYPES) :], pay_at[p]
                continue
            weight = np.zeros(n, np.float32)
            for j in range(p, p + int(many[k])):
                a, z = int(at[j]), int(at[j] + size[j])
                v = np.minimum(np.arange(1, z - a + 1), np.arange(z - a, 0, -1)).astype(np.float32)
                if a == 0:
                    v[: (z - a) // 2] = z - a
                if z == n:
                    v[(z - a) // 2 :] = z - a
                total[o + a : o + z, 1::2] += got[j][:, : len(TYPES)] * v[:, None]
                total[o + a : o + z, 2::2] += got[j][:, len(TYPES) :] * v[:, None]
                weight[a:z] += v
            total[o : o + n] /= weight[:, None]
        may = self.most(total, begins) >= 0
        # An interval in which no run that pays may end has none.
        new = may.copy()
        new[1:] &= ~may[:-1]
        new[begins] |= may[begins]
        if (at := np.flatnonzero(new)).size:
            pays = np.logical_or.reduceat(hot & may, at)
            may &= pays[np.maximum(np.cumsum(new) - 1, 0)]
        some = np.logical_or.reduceat(may, begins)
        return {int(k): (total[a:z], may[a:z]) for k, a, z, s in zip(opened, begins, ends, some, strict=True) if s}

    def _moves(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Transitions and starts over those of O, and the most that going back to O pays."""
        tr = self.p["T"] - self.p["T"][0, 0]
        return tr, self.p["S"] - self.p["S"][0], max(0.0, float(tr[1:, 0].max()))

    def most(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """An upper bound, for each character, of what a run of tags but O that
        holds it can gain over staying with O; scores are (characters, tags) of
        stretches one after the other, which begin at ``first``."""
        tr, st, leave = self._moves()
        lead = np.ascontiguousarray((scores[:, 1:] - scores[:, :1]).T)
        enter = (lead + tr[0, 1:, None]).max(0)
        enter[first] = np.maximum(enter[first], (lead[:, first] + st[1:, None]).max(0))
        go_on = (lead + tr[1:, 1:].max(0)[:, None]).max(0)
        go_on[first] = -1e6  # no run goes on from one stretch to the next
        return best_through(enter[:, None], go_on[:, None])[:, 0] + leave

    def tags(self, scores: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The best tags of each stretch. Only intervals that may hold tags but
        O are searched, each with a certain O at either side."""
        out, parts, places = [], [], []
        for j, (s, may) in enumerate(scores):
            out.append(np.zeros(len(s), np.int8))
            edge = np.flatnonzero(np.diff(np.r_[False, may, False]))
            for a, z in zip(edge[::2], edge[1::2], strict=True):
                lo, hi = max(0, a - 1), min(len(s), z + 1)
                e = s[lo:hi].copy()
                if lo < a:
                    e[0, 1:] = -1e6
                if hi > z:
                    e[-1, 1:] = -1e6
                parts.append(e)
                places.append((j, lo, hi))
        for (j, lo, hi), got in zip(places, self.viterbi(parts), strict=True):
            out[j][lo:hi] = np.where(got > 0, got, out[j][lo:hi])
        return out

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each stretch; stretches of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(s), np.int8) for s in scores]
        tr, k = self.p["T"], len(TAGS)
        order = [j for j, s in enumerate(scores) if len(s)]
        order.sort(key=lambda j: len(scores[j]))
        while order:  # the longest first, at most CELLS cells at once
            longest = len(scores[order[-1]])
            n = min(BATCH, max(1, CELLS // longest), sum(2 * len(scores[j]) >= longest for j in order[-BATCH:]))
            part, order = order[-n:], order[:-n]
            t, b = len(scores[part[-1]]), len(part)
            best = np.zeros((t, k, b), np.float32)
            size = np.array([len(scores[j]) for j in part])
            for c, j in enumerate(part):
                best[: size[c], :, c] = scores[j]
            best[0] += self.p["S"][:, None]
            z = np.empty((k, k, b), np.float32)
            for s in range(1, t):
                np.add(best[s - 1][:, None], tr[:, :, None], out=z)
                best[s] += z.max(0)
            # Backwards only along the best path, from each stretch's own end.
            tags = np.zeros((t, b), np.int8)
            for s in range(t - 1, -1, -1):
                a = best[s]
                if s + 1 < t:
                    a = np.where(s + 1 < size, a + tr.T[tags[s + 1]].T, a)
                tags[s] = a.argmax(0)
            for c, j in enumerate(part):
                out[j] = tags[: size[c], c]
        return out


class Runs:
    """Where a run of tags but O can pay: an upper bound of the best value of a
    run that ends at a cell in a tag, as Viterbi has it, without its path.

    Within a type transitions are as they stand. Any other, from x to y, is
    replaced by out[x] + into[y], which is no less than it; ``into`` also holds
    for coming from O.
    """

    def __init__(self, tagger: Tagger):
        tr, st, _ = tagger._moves()
        kind = tagger.p["E"].dtype
        b, i = np.arange(1, len(TAGS), 2), np.arange(2, len(TAGS), 2)
        tags, own = np.r_[b, i], np.arange(len(b))
        out = (tr[1:, b] - tr[0, b]).max(1)
        other = tr[1:, i] - out[:, None]
        other[b - 1, own] = other[i - 1, own] = -1e6
        into_i = np.maximum(tr[0, i], other.max(0))
        # Values in a B tag are kept with what going on costs more than going on from the I tag.
        more = np.r_[tr[b, i] - tr[i, i], 0 * own]
        col = lambda v: np.ascontiguousarray(v[:, None], kind)
        self.out, self.leave = col(out[tags - 1] - more), col(tr[tags, 0] - more)
        self.into_b, self.into_i = col(tr[0, b] + more[own]), col(into_i - tr[i, i])
        self.start, self.end = (st - tr[0])[tags].astype(kind), -tr[tags, 0].astype(kind)
        #: What the leads that pay() takes have more.
        self.added = np.r_[0 * own, tr[i, i]].astype(kind)

    def pay(self, leads: np.ndarray, outside: np.ndarray, begin: np.ndarray, last: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Cells (step, lane) at which a run that pays may end. leads: (step,
        tag but O, lane), B tags first, with ``added``; outside: cells of no
        text; begin, last: the texts' first and last steps, in ``lane``. A
        text's first character has the tags' starts, and at its last leaving
        costs nothing."""
        t, k, b = leads.shape
        at, off = np.nonzero(outside)
        kept = leads[begin, :, lane], leads[last, :, lane]
        leads[at, :, off] = -1e6
        leads[begin, :, lane] += self.start
        leads[last, :, lane] += self.end
        kind, half = leads.dtype, k // 2
        v, r, q, m = np.full((k, b), -1e6, kind), np.empty((k, b), kind), np.empty((half, b), kind), np.empty((1, b), kind)
        vb, vi = v[:half], v[half:]
        left = np.empty((t, b), kind)
        for s in range(t):
            np.add(v, self.out, out=r)
            np.maximum.reduce(r, 0, out=m, keepdims=True)
            np.maximum(m, 0, out=m)
            np.maximum(vb, vi, out=vi)
            np.add(m, self.into_i, out=q)
            np.maximum(vi, q, out=vi)
            np.add(m, self.into_b, out=vb)
            np.add(v, leads[s], out=v)
            np.add(v, self.leave, out=r)
            np.maximum.reduce(r, 0, out=left[s])
        leads[begin, :, lane], leads[last, :, lane] = kept
        # The margin is for rounding.
        return left > -1e-3


def best_through(enter: np.ndarray, go_on: np.ndarray) -> np.ndarray:
    """For each cell of (T, B), the most that a run down the column can gain
    which holds it: ``enter`` at its first cell, ``go_on`` at the others."""
    c = np.cumsum(go_on, 0, dtype=np.float64)
    ahead = np.maximum.accumulate(c[::-1], 0)[::-1] - c
    return c + np.maximum.accumulate(enter - c, 0) + ahead


_FORM = {
    "email": re.compile(r".*[\w)\]](?:\s?@\s?|\s?[(\[<{] ?(?:at|arroba|a) ?[)\]>}]\s?| at | arroba )[\w-]", re.I | re.S),
    "phone": re.compile(r"[+(]?\d[\d ()./-]{5,}"),
    "id_number": re.compile(r"[A-Z]{0,3}[ -]?\d[\d -]{4,}", re.I),
    "name": re.compile(r"[A-Za-z\x01\x03-\x05][A-Za-z\x01\x03-\x05'. \n-]*(?:,[A-Za-z\x01\x03-\x05'. \n-]+)?$"),
    "address": re.compile(r".*\d", re.S),
}


#: What belongs to a span if it stands right before it.
_EDGE = {
    "email": re.compile(r"[\w.+-]*$"),
    "phone": re.compile(r"(?:[+(]?\d[\d ()./-]{0,12})?[+(\d]*$"),
    "id_number": re.compile(r"(?:(?<![A-Za-z\d])[A-Z]{0,2}[ -]?(?:\d{2,3}[ -]){0,3})?[A-Za-z\d]*$"),
    "address": re.compile(rf"(?:(?:\d{{1,4}}[a-c]?(?: bis)?,? )?(?:(?i:{_STREET_WORD}|calle|c/|avda\.|avenida|plaza|paseo|camino) )?(?:(?:de|del|du|des|la|las|los|l') ?){{0,2}})?[A-Za-z\d'-]*$"),
    "name": re.compile(r"[A-Za-z\x01\x04'-]*$"),
}


def spans_of(view: str, start: int, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans in ``view``, snapped to token edges and checked for form."""
    got: list[list] = []
    i, n = 0, len(tags)
    while i < n:
        if not tags[i]:
            i += 1
            continue
        kind = (int(tags[i]) - 1) // 2
        j = i + 1
        while j < n and tags[j] == 2 * kind + 2:
            j += 1
        got.append([start + i, start + j, TYPES[kind]])
        i = j
    out = []
    for a, z, kind in got:
        a -= len(_EDGE[kind].search(view[max(0, a - 40) : a])[0])
        tail = re.compile({"email": r"[\w.-]*", "phone": r"\d*", "id_number": r"[A-Za-z\d]*", "address": r"[A-Za-z\d]*", "name": r"[A-Za-z\x01\x04'-]*"}[kind]).match(view, z)
        z = tail.end()
        while a < z and view[a] in " ,;:.\n-\"'":
            a += 1
        while z > a and view[z - 1] in " ,;:\n-\"'(":
            z -= 1
        if kind == "email":
            # No address runs over a line end, and none starts with its own separator.
            line = next(((a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", view[a:z]) if _FORM["email"].match(m[0])), (a, z))
            a, z = line
            if re.match(r"(?i)[(\[ ]*(?:dot|punto|at|arroba)\b", view[a:z]):
                a -= len(re.search(r"(?:[\w+-]+[\s.]*)?$", view[max(0, a - 40) : a])[0])
        s = view[a:z]
        digits = sum(c.isdigit() for c in s)
        if kind == "name":
            title = _TITLE.match(s)
            if title:
                a, s = a + title.end(), s[title.end():]
            # Two words, but for scripts without blanks.
            if s.count("\x03") + s.count("\x05") < 2 and sum(len(w) > 1 for w in re.findall(r"[A-Za-z\x01\x04'-]+", s)) < 2:
                continue
        if kind == "phone" and _DATE.fullmatch(s):
            continue
        ok = bool(_FORM[kind].match(s)) and {"email": len(s) > 5, "phone": 7 <= digits <= 15, "id_number": digits >= 6, "name": digits == 0, "address": digits >= 1 and len(s) > 6}[kind]
        if ok and (not out or a >= out[-1][1]):
            out.append((a, z, kind))
    return out


def find(texts: list[str | None], tagger: Tagger, table: Folds) -> list[list[tuple[int, int, str]]]:
    """For each text its spans (start, end, type) in stored positions."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    same: dict[str, list[int]] = {}
    for k, t in enumerate(texts):
        if t:
            same.setdefault(t, []).append(k)
    views = {t: v for t in same if (v := t if t.isascii() else t.translate(table))}
    if not views:
        return found
    stored, every = list(views), list(views.values())
    some = tagger.emissions(codes("".join(every)), np.array([len(v) for v in every]))
    for j, tags in zip(some, tagger.tags(list(some.values())), strict=True):
        if not tags.any():
            continue
        at = positions(stored[j], table)
        spans = [(s, e, kind) if at is None else (int(at[s]), int(at[e - 1]) + 1, kind) for s, e, kind in spans_of(every[j], 0, tags)]
        for k in same[stored[j]]:
            found[k] = list(spans)
    return found


def padded(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, tags and mask of windows, each (T, B)."""
    t = max(len(a) for a, _ in windows)
    x, y, m = np.full((t, len(windows)), 97, np.int64), np.zeros((t, len(windows)), np.int64), np.zeros((t, len(windows)), bool)
    for j, (a, z) in enumerate(windows):
        x[: len(a), j], y[: len(a), j], m[: len(a), j] = a, z, True
    return x, y, m


def _serve(hidden: int, shard: Callable, pipe) -> None:
    one_thread()
    tagger = Tagger(hidden)
    while (job := pipe.recv()) is not None:
        n, tagger.p = job
        pipe.send(tagger.step(*padded(shard(n))))


def training_windows(examples: list[tuple[str, list[tuple[int, int, str]]]], table: Folds) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of labelled texts, with a tag a character."""
    number = {t: k for k, t in enumerate(TYPES)}
    out = []
    for text, spans in examples:
        view, at = folded(text, table)
        tags = np.zeros(len(view), np.int64)
        stored = np.arange(len(view)) if at is None else at
        for a, z, kind in spans:
            inside = np.flatnonzero((stored >= a) & (stored < z))
            if inside.size:
                tags[inside] = 2 * number[kind] + 2
                tags[inside[0]] = 2 * number[kind] + 1
        c = codes(view)
        for s in range(0, max(1, len(view) - WINDOW + STRIDE), STRIDE):
            e = min(len(view), s + WINDOW)
            if e - s > 1:
                out.append((c[s:e], tags[s:e]))
    return out


def plain_pieces(texts: list[str], table: Folds | None = None, longest: int = 400) -> list[str]:
    """Runs of sentences of ``texts``, as they stand, that hardly hold anything
    personal: no mail sign, no surface of a number or address as in
    pii_training, no given name."""
    from .pii_training import GIVEN

    table, names, out = table or Folds(), {g.lower() for g in GIVEN}, []
    for t in texts:
        run = ""
        for piece in re.split(r"(?<=[.!?])(?=\s)|(?<=[。！？])|(?<=\n)", t):
            view, _ = folded(piece, table)
            bad = _MAIL.search(view.lower()) or _SURE.search(view) or {w.lower() for w in re.findall(r"[A-Za-z]+", view)} & names
            if bad or len(run) + len(piece) > longest:
                out.append(run.strip())
                run = ""
            if not bad and len(piece) <= longest:
                run += piece
        out.append(run.strip())
    return [x for x in out if len(x) > (12 if x.isascii() else 4)]


def composed(seed: int, background: list[str], batch: int = 96, pool: int = 8) -> Callable[[int], list[tuple[np.ndarray, np.ndarray]]]:
    """A shard for Tagger.fit: new composed texts at every step.

    ``pool`` batches are made at a time and cut by length, so that a batch has
    little padding; shards take like lengths at the same step.
    """
    from .pii_training import example

    table = Folds()
    ready: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def make(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        nonlocal ready
        block, k = divmod(n - 1, pool)
        if not k:
            r = random.Random(seed * 1_000_003 + block)
            some = sorted(training_windows([example(r, background) for _ in range(batch * pool)], table), key=lambda w: len(w[0]))
            ready = [some[len(some) * j // pool : len(some) * (j + 1) // pool] for j in range(pool)]
            random.Random(block).shuffle(ready)
        return ready[k]

    return make


def train(steps: int, seed: int = 3, background: list[str] | None = None, report=None, start: Tagger | None = None, rate: float = 4e-3, processes: int = 1, hidden: int = HIDDEN) -> Tagger:
    """A tagger from composed texts (see pii_training), new ones at each step.

    ``background``: texts without personal information to mix in, a bounded
    sample; those with a surface that might be personal are left out.
    ``start``: a tagger to go on from, at a lower ``rate``.
    """
    return (start or Tagger(hidden)).fit([composed(seed + 101 * k, background or []) for k in range(processes)], steps, rate=rate, report=report)


def _run(weights: dict[str, np.ndarray], replace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        tagger = Tagger(weights["Uf"].shape[0])
        tagger.p = weights
        table = Folds()
        for b in batches:
            every = b["text"].to_pylist()
            ends = np.cumsum([len(t or "") for t in every])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
                part, texts = b.slice(lo, hi - lo), every[lo:hi]
                lo = hi
                got = find(texts, tagger, table)
                if replace:
                    out = []
                    for t, spans in zip(texts, got, strict=True):
                        for a, z, kind in reversed(spans):
                            t = f"{t[:a]}[{kind.upper()}]{t[z:]}"
                        out.append(t)
                    yield pa.RecordBatch.from_arrays([part["key"], pa.array(out, pa.string())], ["key", "masked"])
                    continue
                at = [k for k, s in enumerate(got) for _ in s]
                flat = [x for s in got for x in s]
                cols = [pa.array([x[i] for x in flat], k) for i, k in ((2, pa.string()), (0, pa.int32()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(at, pa.int64())), *cols], ["key", "pii_type", "start_pos", "end_pos"])

    return run


def personal_spans(texts: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``key, pii_type, start_pos, end_pos`` for each occurrence.

    ``texts``: ``key`` (any type), ``text``. Positions are code points of the
    stored text, the end exclusive. Null and empty texts have none; repeated
    rows repeat theirs; texts of any length are decoded as a whole; extra
    columns are ignored.
    """
    tagger = tagger or Tagger.load()
    kind = texts.schema["key"].dataType.simpleString()
    return spread(texts.where("text is not null").select("key", "text")).mapInArrow(_run(tagger.p, False), f"key {kind}, pii_type string, start_pos int, end_pos int")


def masked_texts(texts: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``key, masked``: typed placeholders such as [NAME] for each occurrence;
    the rest of the text is unchanged. Null texts stay null."""
    tagger = tagger or Tagger.load()
    kind = texts.schema["key"].dataType.simpleString()
    some = spread(texts.where("text is not null").select("key", "text")).mapInArrow(_run(tagger.p, True), f"key {kind}, masked string")
    return some.unionByName(texts.where("text is null").select("key", F.lit(None).cast("string").alias("masked")))
