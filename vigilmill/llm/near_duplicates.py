"""Near-duplicate records by distinct words, with a count-vector R-tree.

Each text becomes its set of distinct words (as a reader sees them). Words are
hashed into 16 groups; the counts per group are a point. Two sets with counts a
and b share at most sum(min(a, b)) words, and Jaccard similarity t needs
t / (1 + t) * (|A| + |B|) shared ones, so a summed minimum below that rules a
pair out, for two points as for the bounding boxes of two leaves of points.

A tree alone doesn't cut down the number of pairs here: the points of unrelated
texts lie as close in 16 dimensions as boxes can tell apart (see README), so
its root level is a routing level: 40 keys of 7 min-hashes each. A pair at
0.75 shares a key with probability 0.997, at 0.8 with 0.9999. Below a routing
key, points are packed into leaves of at most 512 in order of their vectors;
pairs come from within a leaf and from leaves whose boxes pass the bound: inner
nodes of the leaves are joined first, then the leaves below pairs of nodes that
pass. Survivors are verified on the sets of 32-bit word hashes: two different
words of a pair count as one with probability 2**-32.

Identical sets are one class, so copies multiply neither points nor pairs. A
routing key that many sets share is salted by vector and its leaves are joined
by box, so no group is ever held in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import resolve_forest
from ..session import Scratch, spread
from .visual import _Folds, look

GROUPS, FULL = 16, 15
BANDS, ROWS = 40, 7
LEAF = 512
#: Leaves below an inner node.
FAN = 32
SALTS = 64
#: Bytes of routed rows a task should get.
TASK_BYTES, ROUTED_BYTES = 64 << 20, 24
#: Rows sampled to find routing keys that need salt; results don't depend on it.
SAMPLE = 20_000
#: Ids of one class that meet in one join key; results don't depend on it.
BLOCK = 1000
_ASCII_WORDS = re.compile(r"[a-z0-9]+")
_WORDS = re.compile(r"[^\W_]+")


def word_list(text: str, table: dict | None = None) -> list[str]:
    """Runs of letters and digits as a reader sees them, case ignored."""
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    return _WORDS.findall(look(text, table).casefold())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_counts(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of 16 groups, 4 bits each, 15 meaning 15 or more."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    c = np.bincount(row * GROUPS + (words & np.uint32(GROUPS - 1)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)
    c = np.minimum(c, FULL).astype(np.uint64)
    return (c << (np.uint64(4) * np.arange(GROUPS, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def unpack_counts(packed: np.ndarray) -> np.ndarray:
    return ((packed.view(np.uint64)[:, None] >> (np.uint64(4) * np.arange(GROUPS, dtype=np.uint64))) & np.uint64(15)).astype(np.int16)


def may_reach(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Whether pairs of count vectors allow similarity t; a full group is no bound."""
    least = np.minimum(a, b)
    need = t / (1 + t) * (a.sum(1) + b.sum(1))
    return (least.sum(1) + 1e-9 >= need) | (least == FULL).any(1)


def min_hashes(words: np.ndarray, offsets: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` min-hashes per set (sets are not empty)."""
    rng = np.random.default_rng(7)
    mul = rng.integers(0, 2**32, count, np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, count, np.uint32)
    out = np.empty((len(offsets) - 1, count), np.uint32)
    base = (_mix(words) >> np.uint64(32)).astype(np.uint32)
    h = np.empty_like(base)
    for k in range(count):
        np.multiply(base, mul[k], out=h)
        np.bitwise_xor(h, add[k], out=h)
        np.bitwise_xor(h, h >> np.uint32(15), out=h)
        np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
        out[:, k] = np.minimum.reduceat(h, offsets[:-1])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit routing key per band."""
    n = len(signatures)
    s = signatures.reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key ^ s[:, :, r]) + np.uint64(r)
    return key.view(np.int64)


def _sets(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        folds = _Folds()
        for b in batches:
            keep, key, sets, size = [], [], [], []
            for i, t in enumerate(b["text"].to_pylist()):
                words = word_list(t, folds)
                if len(words) < least_words:
                    continue
                own = []
                for w in set(words):
                    c = codes.get(w)
                    if c is None:
                        if len(codes) > 500_000:  # bounds the worker's memory; codes are hashes, so dropping them is harmless
                            codes.clear()
                        c = codes[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
                    own.append(c)
                raw = np.unique(np.array(own, np.uint32)).tobytes()
                keep.append(i)
                sets.append(raw)
                size.append(len(raw) // 4)
                key.append(blake2b(raw, digest_size=16).digest())
            at = pa.array(keep, pa.int64())
            short = np.array([int.from_bytes(k[:8], "little", signed=True) for k in key], np.int64)
            yield pa.RecordBatch.from_arrays([b["space"].take(at), b["id"].take(at), pa.array(key, pa.binary()), pa.array(short), pa.array(sets, pa.binary())], ["space", "id", "key", "short", "words"])

    return run


def _arrays(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = sets.to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint32), offsets


def _route(hot: frozenset[int]):
    """Sets to rows ``route, band, short, counts``; salted where hot."""
    hot_keys = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                words, offsets = _arrays(part["words"])
                keys = band_keys(min_hashes(words, offsets))
                space = (_mix(np.array([hash_text(s) for s in part["space"].to_pylist()], np.uint64))).view(np.int64)
                keys = keys ^ space[:, None]
                counts = pack_counts(words, offsets)
                short = part["short"].to_numpy()
                band = keys.ravel()
                c, s = np.repeat(counts, BANDS), np.repeat(short, BANDS)
                route = band
                if hot_keys.size:
                    salt = (_mix(c.view(np.uint64)) % np.uint64(SALTS) + np.uint64(1)).view(np.int64)
                    route = np.where(np.isin(band, hot_keys), band ^ (salt << 32), band)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(band), pa.array(s), pa.array(c)], ["route", "band", "short", "counts"])

    return run


def hash_text(s: str | None) -> int:
    return int.from_bytes(blake2b((s or "").encode(), digest_size=8).digest(), "little")


def run_pairs(group: np.ndarray, counts: np.ndarray, short: np.ndarray, t: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs of equal ``group`` that pass the bound."""
    out, d, i = [], 1, np.arange(len(group) - 1)
    vec = unpack_counts(counts)
    while i.size:
        i = i[group[i] == group[i + d]]
        if i.size:
            ok = i[may_reach(vec[i], vec[i + d], t) & (short[i] != short[i + d])]
            out.append((short[ok], short[ok + d]))
        d += 1
        i = i[i + d < len(group)]
    return out


def _leaves(t: float, hot: frozenset[int]):
    """Sorted routed rows to pairs, and to leaves where a key has several."""
    hot_keys = np.array(sorted(hot), np.int64)

    def pairs(found) -> Iterator[pa.RecordBatch]:
        for a, b in found:
            if a.size:
                x, y = np.minimum(a, b), np.maximum(a, b)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.nulls(n, k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]], NAMES)

    def leaf(band, counts, short) -> pa.RecordBatch:
        v = unpack_counts(counts)
        lo, hi = v.min(0).astype(np.uint8).tobytes(), v.max(0).astype(np.uint8).tobytes()
        blob = np.stack([short, counts]).tobytes()
        one = lambda x, k: pa.array([x], k)
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), one(int(band), pa.int64()), one(lo, pa.binary()), one(hi, pa.binary()), one(blob, pa.binary())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4  # route, band, short, counts of the unfinished run
        split = None  # the route of the unfinished run, if it already has a leaf

        def done(cols, last):
            """Whole runs of ``cols``; the last run stays back unless ``last``."""
            nonlocal rest, split
            route, band, short, counts = cols
            if not len(route):
                return
            starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
            ends = np.r_[starts[1:], len(route)]
            if not last:
                rest = [c[starts[-1]:] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = [c[:0] for c in cols]
            big = (ends - starts > LEAF) | np.isin(band[starts], hot_keys) | (route[starts] == split if split is not None else False)
            small = np.zeros(len(route), bool)
            for a, z in zip(starts[~big], ends[~big], strict=True):
                small[a:z] = z - a > 1
            yield from pairs(run_pairs(route[small], counts[small], short[small], t))
            for a, z in zip(starts[big], ends[big], strict=True):
                for k in range(a, z, LEAF):
                    e = min(z, k + LEAF)
                    yield from pairs(run_pairs(route[k:e], counts[k:e], short[k:e], t))
                    yield leaf(band[k], counts[k:e], short[k:e])
            # A run longer than a batch gives its full leaves away at once.
            while not last and len(rest[0]) >= 4 * LEAF:
                cut = [c[:LEAF] for c in rest]
                split = rest[0][0]
                yield from pairs(run_pairs(cut[0], cut[3], cut[2], t))
                yield leaf(cut[1][0], cut[3], cut[2])
                rest = [c[LEAF:] for c in rest]

        for b in batches:
            cols = [np.concatenate([r, b[k].to_numpy()]) for r, k in zip(rest, ("route", "band", "short", "counts"), strict=True)]
            yield from done(cols, False)
        yield from done(rest, True)

    return run


NAMES = ["a", "b", "band", "lo", "hi", "members"]
_SCHEMA = "a bigint, b bigint, band bigint, lo binary, hi binary, members binary"


def boxes_may_meet(lo_a: bytes, hi_a: bytes, lo_b: bytes, hi_b: bytes, t: float) -> bool:
    """The bound for two leaves: no pair of their points can do better."""
    la, ha, lb, hb = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (lo_a, hi_a, lo_b, hi_b))
    least = np.minimum(ha, hb)
    return bool((least == FULL).any() or least.sum() + 1e-9 >= t / (1 + t) * (la.sum() + lb.sum()))


def _box_filter(t: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [boxes_may_meet(*x, t) for x in zip(*[b[k].to_pylist() for k in ("lo", "hi", "lo_b", "hi_b")], strict=True)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    return run


def _leaf_pairs(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b["members"].to_pylist(), b["members_b"].to_pylist(), strict=True):
                (sa, ca), (sb, cb) = (np.frombuffer(m, np.int64).reshape(2, -1) for m in (x, y))
                va, vb = unpack_counts(ca.copy()), unpack_counts(cb.copy())
                for i in range(len(sa)):
                    ok = may_reach(np.broadcast_to(va[i], vb.shape), vb, t) & (sb != sa[i])
                    if ok.any():
                        p, q = np.minimum(sa[i], sb[ok]), np.maximum(sa[i], sb[ok])
                        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return run


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, sim = [], []
            for x, y in zip(b["words_a"].to_pylist(), b["words_b"].to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(u) + len(v) - len(np.union1d(u, v))
                s = both / (len(u) + len(v) - both)
                ok.append(s >= t - 1e-12)
                sim.append(s)
            yield pa.RecordBatch.from_arrays([b["space"], b["key_a"], b["key_b"], pa.array(sim, pa.float64())], ["space", "key_a", "key_b", "similarity"]).filter(pa.array(ok, pa.bool_()))

    return run


class NearDuplicates:
    """Near-duplicate classes and links of ``texts`` (space, id, text).

    ``similarity`` is Jaccard on distinct words; only texts of at least
    ``least_words`` words take part. Rows with null id or text are left out,
    repeated rows count once, copies of an id with different texts count each.
    Empty tables give empty results; extra columns are ignored.
    """

    def __init__(self, texts: DataFrame, similarity: float = 0.75, least_words: int = 40):
        self.t = similarity
        self.scratch = Scratch(texts.sparkSession, "neardup")
        long_enough = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= 2 * least_words - 1)).select("space", "id", "text")
        self.sets = self.scratch.put(spread(long_enough).mapInArrow(_sets(least_words), "space string, id string, key binary, short bigint, words binary"), "sets")
        self._links: DataFrame | None = None

    def _hot(self) -> frozenset[int]:
        """Routing keys with more than 0.3 % of a bounded sample of rows. A key
        just below that is a run which one task streams leaf by leaf."""
        n = self.sets.count()
        if n < SAMPLE // 10:
            return frozenset()
        some = self.sets.sample(min(1.0, SAMPLE / n), seed=3)
        rows = some.dropDuplicates(["space", "short"]).mapInArrow(_route(frozenset()), "route bigint, band bigint, short bigint, counts bigint")
        seen = rows.groupBy("band").count().where(F.col("count") > max(50, min(n, SAMPLE) * 3 // 1000)).select("band")
        return frozenset(r[0] for r in seen.collect())  # at most 333 per band

    def links(self) -> DataFrame:
        """``space, key_a, key_b, similarity``: class pairs, key_a < key_b."""
        if self._links is not None:
            return self._links
        t, hot = self.t, self._hot()
        routed = self.sets.mapInArrow(_route(hot), "route bigint, band bigint, short bigint, counts bigint")
        # As many tasks as keep each small, however large the input.
        tasks = max(self.sets.sparkSession.sparkContext.defaultParallelism * 2, -(-self.sets.count() * BANDS * ROUTED_BYTES // TASK_BYTES))
        packed = routed.repartition(tasks, "route").sortWithinPartitions("route", "counts", "short").mapInArrow(_leaves(t, hot), _SCHEMA)
        packed = self.scratch.put(packed, "leaves")
        leaves = packed.where("band is not null").select("band", "lo", "hi", "members").withColumn("leaf", F.xxhash64("band", "members"))
        # Inner nodes: leaves of one band whose boxes start alike, FAN or so a node.
        many = leaves.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("nodes"))
        box = self.scratch.put(leaves.select("band", "leaf", "lo", "hi").join(many, "band").withColumn("node", F.least(F.floor(F.conv(F.hex(F.substring("lo", 1, 2)), 16, 10).cast("long") * F.col("nodes") / (FULL * 256 + FULL + 1)), F.col("nodes") - 1).cast("int")), "boxes")
        corner = lambda c, f: F.concat(*[f(F.substring(c, i + 1, 1)).alias(f"{c}{i}") for i in range(GROUPS)])
        inner = self.scratch.put(box.groupBy("band", "node").agg(corner("lo", F.min).alias("lo"), corner("hi", F.max).alias("hi")), "inner")
        other = inner.select("band", F.col("node").alias("node_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        nodes = inner.join(other, "band").where("node <= node_b").mapInArrow(_box_filter(t, ["band", "node", "node_b"]), "band bigint, node int, node_b int")
        right = box.select("band", F.col("node").alias("node_b"), F.col("leaf").alias("leaf_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        pairs = nodes.join(box, ["band", "node"]).join(right, ["band", "node_b"]).where("node < node_b or leaf < leaf_b").where("leaf <> leaf_b")
        near = pairs.mapInArrow(_box_filter(t, ["leaf", "leaf_b"]), "leaf bigint, leaf_b bigint").select(F.least("leaf", "leaf_b").alias("leaf"), F.greatest("leaf", "leaf_b").alias("leaf_b")).distinct()
        full = leaves.select("leaf", "members").dropDuplicates(["leaf"])
        across = near.join(full, "leaf").join(full.select(F.col("leaf").alias("leaf_b"), F.col("members").alias("members_b")), "leaf_b").select("members", "members_b").mapInArrow(_leaf_pairs(t), "a bigint, b bigint")
        cand = packed.where("a is not null").select("a", "b").unionByName(across).distinct()
        cand = self.scratch.put(cand, "candidates")
        ends = cand.select(F.col("a").alias("short")).unionByName(cand.select(F.col("b").alias("short"))).distinct()
        words = self.sets.join(ends, "short", "left_semi").select("space", "short", "key", "words").dropDuplicates(["space", "key"])
        words = self.scratch.put(words, "words")
        left = words.select("space", F.col("short").alias("a"), F.col("key").alias("key_a"), F.col("words").alias("words_a"))
        right = words.select("space", F.col("short").alias("b"), F.col("key").alias("key_b"), F.col("words").alias("words_b"))
        both = cand.join(left, "a").join(right, ["space", "b"]).select("space", "key_a", "key_b", "words_a", "words_b")
        kept = both.mapInArrow(_verify(t), "space string, key_a binary, key_b binary, similarity double")
        self._links = self.scratch.put(kept.select("space", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity"), "links")
        self.scratch.drop(packed, cand, words)
        return self._links

    def members(self) -> DataFrame:
        """``space, id, key``: the class of identical word sets of each id."""
        return self.sets.select("space", "id", "key").distinct()

    def pairs(self, all_pairs: int | None = None) -> DataFrame:
        """``space, id_a, id_b``: all pairs of ids at the similarity.

        Classes are cut into blocks of about ``BLOCK`` ids, and blocks are
        joined with blocks, so no join key grows with a hot class. With
        ``all_pairs``, classes of more ids than that are given by their first
        id against each other id and stand in links by it; then the result is
        linear in the rows, and only ``members`` and ``links`` give the rest.
        """
        m = self.scratch.put(self.members(), "members")
        size = m.groupBy("space", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        sized = self.scratch.put(m.join(size, ["space", "key"]).select("space", "key", "id", "n", "first"), "sized")
        few = F.lit(True) if all_pairs is None else F.col("n") <= all_pairs
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("id"), blocks).cast("int")
        several = sized.where(few & (F.col("n") > 1)).select("space", "key", "id", blocks.alias("blocks"), block.alias("block"))
        # The pair of blocks (i, j), i <= j, meets once: the left side has i, the right one j.
        left = several.select("space", "key", "id", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
        right = several.select("space", "key", F.col("id").alias("other"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
        same = left.join(right, ["space", "key", "i", "j"]).where((F.col("id") < F.col("other")) | ((F.col("i") < F.col("j")) & (F.col("id") != F.col("other")))).select("space", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
        star = sized.where(~few & (F.col("id") != F.col("first"))).select("space", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
        # With all_pairs, a class too large to expand stands in a link by its first id.
        rep = sized.where(few | (F.col("id") == F.col("first"))).select("space", "key", "id", block.alias("block"))
        many = size.where(F.col("n") > BLOCK).select("space", "key", blocks.alias("blocks"))
        links = self.links().select("space", "key_a", "key_b")
        for end, at in (("key_a", "i"), ("key_b", "j")):
            links = links.join(many.withColumnRenamed("key", end), ["space", end], "left").withColumn(at, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        a = rep.select("space", F.col("key").alias("key_a"), F.col("id").alias("x"), F.col("block").alias("i"))
        b = rep.select("space", F.col("key").alias("key_b"), F.col("id").alias("y"), F.col("block").alias("j"))
        cross = links.join(a, ["space", "key_a", "i"]).join(b, ["space", "key_b", "j"]).where("x <> y").select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return same.unionByName(star).unionByName(cross).distinct()

    def groups(self, max_rounds: int = 60) -> DataFrame:
        """``space, id, group_key``: one row per id and class, with the least
        class key of all classes that links connect with it.

        Each round hangs a class on its least neighbour, which gives a forest;
        its roots become the classes of the next round.
        """
        name = lambda k: F.concat_ws(":", "space", F.lower(F.hex(k)))
        m = self.members().withColumn("class", name("key"))
        links = self.scratch.put(self.links().select(name("key_a").alias("a"), name("key_b").alias("b")), "edges")
        label = self.scratch.put(m.select(F.col("class").alias("node"), F.col("class").alias("root")).distinct(), "labels")
        for _ in range(max_rounds):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = self.scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "least")
            ends = least.where("parent > node").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
            found, own = resolve_forest(least.where("parent < node"), ends)
            root = self.scratch.put(found.select(F.col("node").alias("n"), F.col("root").alias("r")), "roots")
            own.close()
            label = self.scratch.put(label.join(root, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root")), "labels")
            left = links.join(root, F.col("a") == F.col("n")).select("b", F.col("r").alias("ra")).join(root, F.col("b") == F.col("n")).select(F.least("ra", "r").alias("a"), F.greatest("ra", "r").alias("b")).where("a <> b").distinct()
            links = self.scratch.put(left, "edges")
            if links.isEmpty():
                break
        else:
            raise RuntimeError(f"links remain after {max_rounds} rounds")
        return m.join(label, F.col("class") == F.col("node")).select("space", "id", F.substring_index("root", ":", -1).alias("group_key"))

    def link_counts(self) -> DataFrame:
        """``space, id, n_copies, n_links``: per id, ids with an equal word set
        (itself included) and classes at the similarity."""
        links = self.links()
        ends = links.select("space", F.col("key_a").alias("key")).unionByName(links.select("space", F.col("key_b").alias("key"))).groupBy("space", "key").agg(F.count(F.lit(1)).alias("n_links"))
        m = self.members()
        size = m.groupBy("space", "key").agg(F.count(F.lit(1)).alias("n_copies"))
        return m.join(size, ["space", "key"]).join(ends, ["space", "key"], "left").select("space", "id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
