"""Filling context windows with documents by a grouping genetic algorithm.

A solution is a set of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that then hold an item twice, and puts
the displaced items back by best fit, largest first. Populations live on
islands, each a row that any task may evolve; elites migrate in a ring through a
written table. An island whose best solution has the least possible number of
bins stops. Blocks are hash-sized (about BLOCK items), so a task's work is
bounded and blocks scale with the data. Between rounds the poorly filled bins
of all blocks are dissolved and their items form new blocks: what one block
can't combine, another can.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK = 400
ISLANDS, POPULATION, GENERATIONS, MIGRATE = 3, 4, 9, 3
#: A bin at least this full stays; others are dissolved for the next round.
FULL_ENOUGH = 0.995
ROUNDS = 3
#: Window sizes are a small fixed list; more are refused.
MOST_WINDOWS = 1000
#: Fixed value: the split pattern that belongs to the vocabulary file, if its module is absent.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

Bin = list[int]  # item numbers


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        count = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(count(t)) for t in b["text"].to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every non-null text (a byte-level BPE file)."""
    return spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(_count_tokens(tokenizer), "doc_id bigint, n_tokens bigint")


def best_fit(items: list[int], size: list[int], capacity: int, bins: list[Bin] | None = None, room: list[int] | None = None) -> tuple[list[Bin], list[int]]:
    """Each item, in the order given, into the fullest bin that holds it."""
    bins = bins if bins is not None else []
    room = room if room is not None else []
    order = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in items:
        s = size[i]
        at = bisect_left(order, (s, -1))
        if at < len(order):
            r, k = order.pop(at)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[k] = r - s
        if r > s:
            insort(order, (r - s, k))
    return bins, room


def fitness(room: list[int], capacity: int) -> float:
    """Mean squared fill: prefers few full bins to evenly filled ones."""
    return sum(((capacity - r) / capacity) ** 2 for r in room) / max(1, len(room))


def crossover(a: tuple[list[Bin], list[int]], b: tuple[list[Bin], list[int]], size: list[int], capacity: int, rng: random.Random) -> tuple[list[Bin], list[int]]:
    """Well-filled bins of ``a`` into ``b``; displaced items by best fit."""
    (abins, aroom), (bbins, broom) = a, b
    ranked = sorted(range(len(abins)), key=lambda k: aroom[k])
    good = ranked[: max(1, len(ranked) // 2)]
    inject = [k for k in good if rng.random() < 0.6] or [good[0]]
    taken = {i for k in inject for i in abins[k]}
    bins, room, loose = [list(abins[k]) for k in inject], [aroom[k] for k in inject], []
    for k, items in enumerate(bbins):
        left = [i for i in items if i not in taken]
        if len(left) == len(items):
            bins.append(list(items))
            room.append(broom[k])
        else:
            loose += left
    # Mutation: the emptiest bins, and one at random, are opened too.
    opened = set(sorted(range(len(bins)), key=lambda k: -room[k])[:2]) | {rng.randrange(len(bins))}
    loose += [i for k in opened for i in bins[k]]
    keep = [k for k in range(len(bins)) if k not in opened]
    bins, room = [bins[k] for k in keep], [room[k] for k in keep]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -size[i])
    return best_fit(loose, size, capacity, bins, room)


Solution = tuple[list[Bin], list[int]]  # bins and their room


def score(s: Solution, capacity: int) -> tuple[int, float]:
    return -len(s[0]), fitness(s[1], capacity)


def solution(places: list[int], size: list[int], capacity: int) -> Solution:
    """A solution from each item's bin number."""
    bins: list[Bin] = [[] for _ in range(max(places) + 1)]
    for i, k in enumerate(places):
        bins[k].append(i)
    return bins, [capacity - sum(size[i] for i in b) for b in bins]


def places(s: Solution, n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(s[0]):
        for i in items:
            out[i] = k
    return out


def first_pool(size: list[int], capacity: int, rng: random.Random, population: int) -> list[Solution]:
    """Best fit by size, and best fits of slightly disordered items."""
    n = len(size)
    order = sorted(range(n), key=lambda i: (-size[i], i))
    pool = [best_fit(order, size, capacity)]
    while len(pool) < population:
        some = order[:]
        for k in range(0, n - 1, 2):  # a little disorder keeps best fit good
            j = min(n - 1, k + rng.randrange(1, 12))
            if rng.random() < 0.5:
                some[k], some[j] = some[j], some[k]
        pool.append(best_fit(some, size, capacity))
    return pool


def evolve(size: list[int], capacity: int, pool: list[Solution], seed: int, generations: int, population: int = POPULATION) -> list[Solution]:
    """One island for some generations, the best solution first; it starts
    itself where ``pool`` is empty and stops where no packing has fewer bins."""
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    pool = pool or first_pool(size, capacity, rng, population)
    pool.sort(key=lambda s: score(s, capacity), reverse=True)
    for _ in range(generations if len(size) > 2 else 0):
        if len(pool[0][0]) <= least:
            break
        a, b = pool[0], rng.choice(pool[1:])
        for x, y in ((a, b), (b, a)):
            child = crossover(x, y, size, capacity, rng)
            if score(child, capacity) > score(pool[-1], capacity):
                pool[-1] = child
                pool.sort(key=lambda s: score(s, capacity), reverse=True)
    return pool


def pack(size: list[int], capacity: int, seed: int = 0, islands: int = ISLANDS, generations: int = GENERATIONS, migrate: int = MIGRATE) -> list[Bin]:
    """Bins of item numbers for one block (every size is 1..capacity), with
    all islands in this process: what pack_documents does over tasks."""
    if not size:
        return []
    pools: list[list[Solution]] = [[] for _ in range(islands)]
    for e in range(-(-generations // migrate)):
        pools = [evolve(size, capacity, p, seed * 1009 + e * 31 + k, migrate) for k, p in enumerate(pools)]
        elites = [p[0] for p in pools]
        for k, p in enumerate(pools):
            p[-1] = elites[k - 1]
    return max((p[0] for p in pools), key=lambda s: score(s, capacity))[0]


_KEYS = ["window_name", "capacity", "block"]
_STATE = "window_name string, capacity bigint, block bigint, island int, size array<bigint>, pool array<array<int>>, n_bins int, fit double"


def _evolve(epoch: int, generations: int):
    """Rows of _KEYS, island, size, pool and guest (the elite of the island before, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bins, fit = [], [], []
            for key, capacity, island, size, pool, guest in zip(*[b[c].to_pylist() for c in ("block", "capacity", "island", "size", "pool", "guest")], strict=True):
                own = [solution(p, size, capacity) for p in pool or []]
                if guest:
                    own[-1] = solution(guest, size, capacity)
                own = evolve(size, capacity, own, (key * 1009 + epoch * 31 + island) & 0xFFFFFF, generations)
                # A solved island need not carry its other members on.
                keep = own if len(own[0][0]) > -(-sum(size) // capacity) else own[:1] * len(own)
                out.append([places(s, len(size)) for s in keep])
                bins.append(len(own[0][0]))
                fit.append(fitness(own[0][1], capacity))
            cols = [b[c] for c in ("window_name", "capacity", "block", "island", "size")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.list_(pa.int32()))), pa.array(bins, pa.int32()), pa.array(fit, pa.float64())], [c.split()[0] for c in _STATE.split(", ")])

    return run


_PACKED = "window_name string, capacity bigint, doc_id bigint, piece_no int, n_tokens bigint, block bigint, bin_no int, used bigint"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their best solution to one row an item."""
    for b in batches:
        for window, capacity, block, items, best in zip(*[b[c].to_pylist() for c in ("window_name", "capacity", "block", "items", "best")], strict=True):
            n, used = len(items), [0] * (max(best) + 1)
            for x, k in zip(items, best, strict=True):
                used[k] += x["n_tokens"]
            col = lambda f, k: pa.array([f(i) for i in range(n)], k)
            yield pa.RecordBatch.from_arrays(
                [col(lambda i: window, pa.string()), col(lambda i: capacity, pa.int64()), col(lambda i: items[i]["doc_id"], pa.int64()), col(lambda i: items[i]["piece_no"], pa.int32()),
                 col(lambda i: items[i]["n_tokens"], pa.int64()), col(lambda i: block, pa.int64()), col(lambda i: best[i], pa.int32()), col(lambda i: used[best[i]], pa.int64())],
                [c.split()[0] for c in _PACKED.split(", ")])


def pack_blocks(placed: DataFrame, scratch: Scratch, islands: int = ISLANDS, generations: int = GENERATIONS, migrate: int = MIGRATE) -> DataFrame:
    """Items with a ``block`` (_PACKED): a genetic algorithm per block.

    Each island of a block is a row of its own that any task may evolve; after
    ``migrate`` generations the elites go to the next island of their block
    through a written table.
    """
    blocks = scratch.put(placed.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "n_tokens"))).alias("items")), "blocks")  # about BLOCK items each
    none = F.lit(None)
    state = blocks.select(*_KEYS, F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.n_tokens").alias("size"), none.cast("array<array<int>>").alias("pool"), none.cast("array<int>").alias("guest"))
    state = spread_rows(state)
    for e in range(-(-generations // migrate)):
        if e:
            elite = state.select(*_KEYS, F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("pool")[0].alias("guest"))
            state = state.join(elite, [*_KEYS, "island"])
        state = scratch.put(state.mapInArrow(_evolve(e, migrate), _STATE), "islands")
    best = state.groupBy(*_KEYS).agg(F.max_by(F.col("pool")[0], F.struct(-F.col("n_bins"), "fit", -F.col("island"))).alias("best"))
    return blocks.join(best, _KEYS).mapInArrow(_placed, _PACKED)


def spread_rows(state: DataFrame) -> DataFrame:
    """Islands over all cores: a row is some hundredths of a second of work, and a partition of rows by size alone would hold thousands."""
    return state.repartition(max(2 * state.sparkSession.sparkContext.defaultParallelism, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *_KEYS, "island")


def pack_documents(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Every document in bins of every window size.

    ``documents``: doc_id (unique), text. ``windows``: window_name,
    capacity_tokens. Result: ``window_name, capacity, bin_id, doc_id,
    piece_no, first_token, n_tokens``. A document longer than the window is
    cut into full windows and a rest (pieces 0, 1, ...); no other is split.
    Full pieces are bins of their own and don't enter the search.

    Texts without tokens (null, empty) and windows of null or non-positive
    capacity have no rows; repeated rows of a document are packed each; extra
    columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    counts = scratch.put(token_counts(documents, tokenizer).where("n_tokens > 0"), "tokens")
    sizes = windows.where("window_name is not null and capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(MOST_WINDOWS + 1).collect()
    if len(sizes) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    each = F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for w, c in sorted(sizes)]) if sizes else F.array().cast("array<struct<window_name:string,capacity:bigint>>")
    per = counts.select("doc_id", "n_tokens", F.explode(each).alias("w")).select("doc_id", "n_tokens", "w.window_name", "w.capacity")
    pieces = per.select("window_name", "capacity", "doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr("(n_tokens - 1) div capacity"))).alias("piece_no", "k"), F.col("n_tokens").alias("total"))
    items = pieces.select("window_name", "capacity", "doc_id", "piece_no", F.least(F.col("capacity"), F.col("total") - F.col("k") * F.col("capacity")).alias("n_tokens"))
    whole = items.where("n_tokens = capacity").select("window_name", "capacity", F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string"), F.monotonically_increasing_id().cast("string")).alias("bin_id"), "doc_id", "piece_no", "n_tokens")
    loose = items.where("n_tokens < capacity")
    done = [whole]
    for r in range(rounds):
        per_window = {(w, c): n for w, c, n in loose.groupBy("window_name", "capacity").count().collect()}  # one row a window
        if not per_window:
            break
        limits = spark.createDataFrame([(w, c, max(1, round(n / block))) for (w, c), n in per_window.items()], "window_name string, capacity bigint, blocks bigint")
        placed = loose.join(F.broadcast(limits), ["window_name", "capacity"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(r)), F.col("blocks"))).drop("blocks")
        packed = scratch.put(pack_blocks(placed, scratch), f"round{r}-")
        last = r == rounds - 1
        good = packed if last else packed.where(F.col("used") >= FULL_ENOUGH * F.col("capacity"))
        done.append(good.select("window_name", "capacity", F.concat_ws("-", F.lit(f"r{r}"), F.col("block").cast("string"), F.col("bin_no").cast("string")).alias("bin_id"), "doc_id", "piece_no", "n_tokens"))
        if last:
            break
        loose = packed.where(F.col("used") < FULL_ENOUGH * F.col("capacity")).select("window_name", "capacity", "doc_id", "piece_no", "n_tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("first_token", F.col("piece_no") * F.col("capacity")).select("window_name", "capacity", "bin_id", "doc_id", "piece_no", "first_token", "n_tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per window: bins, tokens, fill, and the least number of bins possible."""
    bins = packed.groupBy("window_name", "capacity", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy("window_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"), F.ceil(F.sum("used") / F.first("capacity")).alias("least_bins"),
    )


