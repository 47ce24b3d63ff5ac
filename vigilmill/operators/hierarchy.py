"""Parent links to full hierarchies, by tree contraction.

Each round rakes leaves and splices out nodes of unary chains, and records
what it took away; the rounds are then undone in reverse order, which gives
every node its root, depth and path. Raking eats trees from below and
splicing shortens chains by a constant share a round, so the number of rounds
grows with the logarithm of the longest chain, not with its length. A cycle is
a core that never loses its last node: splicing shrinks it to a node that is
its own parent, which is how it is detected.

A round is undone from the nodes that were live after it only, so the joins of
both directions shrink geometrically. All are on node ids, which are unique,
except one per undone round: raked leaves look up their parent, and a parent may
have very many leaves. There the leaves are the streamed side of an equi-join
that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bare_id
from ..session import Scratch
from .forum import parent_key

#: Edges that one task may finish in memory (about 20 MB); more are contracted in distributed rounds.
LOCAL_EDGES = 100_000
#: Ids in the paths of one batch; this only bounds memory.
MOST_IDS = 1_000_000
CYCLE = "cycle"


def _coin(c, k: int):
    return F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def contract_arrays(node: np.ndarray, parent: np.ndarray, n: int, seed: int = 0) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """The contraction over integer arrays: recorded steps, and self-parents.

    ``node`` are edges' lower ends (unique), ``parent`` their upper ends, both
    below ``n``. Steps are (nodes, parents, weights) in the order to undo them
    last to first.
    """
    steps, loops = [], []
    up = np.full(n, -1, np.int64)
    up[node] = parent
    weight = np.zeros(n, np.int64)
    weight[node] = 1
    live = np.array(node, np.int64)
    rng = np.random.default_rng(seed)
    while live.size:
        own = up[live] == live
        loops.append(live[own])
        live = live[~own]
        kids = np.bincount(up[live], minlength=n)
        only = np.full(n, -1, np.int64)
        only[up[live]] = live
        coin = rng.integers(0, 2, n, np.int8).astype(bool)
        leaf = kids[live] == 0
        splice = (kids[live] == 1) & coin[live] & ~coin[only[live]]
        s, lf = live[splice], live[leaf]
        steps.append((lf, up[lf], weight[lf]))
        steps.append((s, up[s], weight[s].copy()))
        child = only[s]
        inner = kids[child] > 0  # raked children keep the spliced parent
        child, top = child[inner], s[inner]
        up[child], weight[child] = up[top], weight[child] + weight[top]
        live = live[~(splice | leaf)]
    return steps, np.concatenate(loops) if loops else np.empty(0, np.int64)


def _finish_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: each node's nearest terminal ancestor, distance and path."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    names = pa.concat_arrays([t["node"].combine_chunks(), t["parent"].combine_chunks()]).dictionary_encode()
    code, labels = names.indices.to_numpy(), names.dictionary
    m, n = t.num_rows, len(labels)
    node, parent = code[:m].astype(np.int64), code[m:].astype(np.int64)
    steps, loops = contract_arrays(node, parent, n)
    top, dist = np.arange(n, dtype=np.int64), np.zeros(n, np.int64)
    top[loops], dist[loops] = -1, -1
    for v, p, w in reversed(steps):
        top[v] = top[p]
        dist[v] = np.where(top[p] < 0, -1, dist[p] + w)
    edge = np.full(n, -1, np.int64)
    edge[node] = np.arange(m)
    w0 = t["weight"].to_numpy().astype(np.int64)
    # Weights of edges that were spliced in earlier rounds: a second pass adds them up in order of distance.
    total = np.zeros(n, np.int64)
    for k in np.argsort(dist[node], kind="stable"):
        v = node[k]
        total[v] = -1 if top[v] < 0 else total[parent[k]] + w0[k]
    upper = pa.array(np.where(top[node] < 0, 0, top[node]), mask=top[node] < 0)
    out = {"node": t["node"].combine_chunks(), "top": labels.take(upper), "dist": pa.array(total[node])}
    table = pa.table(out)
    if "seg" not in t.column_names:
        for start in range(0, m, 20_000):
            yield from table.slice(start, 20_000).combine_chunks().to_batches()
        return
    seg, name = t["seg"], labels.to_pylist()

    def between(k: int) -> list[str] | None:
        """The nodes between top and node, by walking up: nothing is kept from row to row."""
        if top[node[k]] < 0:
            return None
        got: list[str] = []
        while True:
            got += reversed(seg[k].as_py())
            p = parent[k]
            if edge[p] < 0:
                return got[::-1]
            got.append(name[p])
            k = edge[p]

    start, held, some = 0, 0, []
    for k in range(m):
        some.append(between(k))
        held += len(some[-1] or ())
        if held > MOST_IDS or k + 1 - start == 20_000 or k + 1 == m:
            part = table.slice(start, k + 1 - start).append_column("seg", pa.array(some, pa.list_(pa.string())))
            yield from part.combine_chunks().to_batches()
            start, held, some = k + 1, 0, []


def resolve_forest(edges: DataFrame, terminals: DataFrame, with_paths: bool = False, local_edges: int = LOCAL_EDGES, max_rounds: int = 200) -> tuple[DataFrame, Scratch]:
    """Root, depth and path of every node of a forest with possible cycles.

    ``edges``: ``node, parent``, one row a node, no nulls; a parent is a node
    of ``edges`` or of ``terminals``. ``terminals``: ``node, root, depth`` and,
    with paths, ``path`` (from the root down to the node itself).

    Returns ``node, root, depth[, path]`` for both, and the scratch folder the
    result reads from. Nodes on a cycle or leading into one have root
    ``cycle``, depth -1 and path null. A self-parent is a cycle. Empty edges
    give the terminals.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "forest")
    seg = [F.col("seg")] if with_paths else []
    ids = "array<string>"
    # A node whose parent is a terminal is anchored: it has a root instead of a parent, weight is its depth and seg its path.
    ends = terminals.select(F.col("node").alias("end"), F.col("root").alias("end_root"), F.col("depth").alias("end_depth"), *([F.col("path").alias("end_path")] if with_paths else []))
    live = edges.join(ends, F.col("parent") == F.col("end"), "left").select(
        "node", F.when(F.col("end").isNull(), F.col("parent")).alias("parent"), F.col("end_root").alias("root"), (F.coalesce("end_depth", F.lit(0)) + 1).cast("long").alias("weight"),
        *([F.coalesce("end_path", F.array().cast(ids)).alias("seg")] if with_paths else []),
    )
    live = scratch.put(live, "edges")
    out_cols = ["node", "root", "depth", *(["path"] if with_paths else [])]
    rounds: list[DataFrame] = []
    left = live.count()
    while left > local_edges:
        k = len(rounds)
        if k == max_rounds:
            raise RuntimeError(f"{left} edges remain after {k} rounds")
        kids = live.where("node <> parent").groupBy(F.col("parent").alias("pid")).agg(F.count(F.lit(1)).alias("kids"), F.min("node").alias("only"))
        m = live.join(kids, live.node == kids.pid, "left")
        what = (
            F.when(F.col("node") == F.col("parent"), F.lit("loop"))
            .when(F.col("kids").isNull(), F.lit("leaf"))
            .when((F.col("kids") == 1) & (_coin(F.col("node"), k) == 1) & (_coin(F.col("only"), k) == 0), F.lit("splice"))
            .otherwise(F.lit("keep"))
        )
        m = scratch.put(m.select("node", "parent", "root", "weight", *seg, "only", what.alias("what")), "round")
        rounds.append(m)
        s = m.where("what = 'splice'").select(F.col("only").alias("child"), F.col("parent").alias("up"), F.col("root").alias("up_root"), F.col("weight").alias("more"), F.col("node").alias("mid"), *([F.col("seg").alias("upper")] if with_paths else []))
        kept = m.where("what = 'keep'").select("node", "parent", "root", "weight", *seg).join(s, F.col("node") == F.col("child"), "left")
        over = F.col("mid").isNotNull()
        live = scratch.put(kept.select(
            "node",
            F.when(over, F.col("up")).otherwise(F.col("parent")).alias("parent"),
            F.when(over, F.col("up_root")).otherwise(F.col("root")).alias("root"),
            (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"),
            *([F.when(over, F.concat("upper", F.array("mid"), "seg")).otherwise(F.col("seg")).alias("seg")] if with_paths else []),
        ), "live")
        left = live.count()

    def anchored(rows: DataFrame) -> DataFrame:
        return rows.where("parent is null").select("node", "root", F.col("weight").alias("depth"), *([F.concat("seg", F.array("node")).alias("path")] if with_paths else []))

    def lost(rows: DataFrame) -> DataFrame:
        return rows.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), *([F.lit(None).cast(ids).alias("path")] if with_paths else []))

    def below(rows: DataFrame, known: list[DataFrame]) -> DataFrame:
        """Rows with a parent, resolved from ``known``."""
        upper = _union(known).select(F.col("node").alias("u"), F.col("root").alias("r"), F.col("depth").alias("d"), *([F.col("path").alias("upper")] if with_paths else []))
        got = rows.where("parent is not null").join(upper, F.col("parent") == F.col("u"))
        depth = F.when(F.col("r") == CYCLE, F.lit(-1).cast("long")).otherwise(F.col("d") + F.col("weight"))
        return got.select("node", F.col("r").alias("root"), depth.alias("depth"), *([F.concat("upper", "seg", F.array("node")).alias("path")] if with_paths else []))

    # What is known at the undoing of a round: one node a cycle, and the nodes that were live after it, so the tables shrink as the rounds did.
    known: list[DataFrame] = [lost(m.where("what = 'loop'")) for m in rounds]
    if left:
        known.append(anchored(live))
        schema = "node string, top string, dist long" + (", seg array<string>" if with_paths else "")
        core = scratch.put(live.where("parent is not null").select("node", "parent", "weight", *seg).coalesce(1).mapInArrow(_finish_local, schema), "core")
        rest = core.where("top is not null").select("node", F.col("top").alias("parent"), F.col("dist").alias("weight"), *seg)
        known += [lost(core.where("top is null")), scratch.put(below(rest, known), "done")]
    for m in reversed(rounds):
        for step in ("splice", "leaf"):
            rows = m.where(F.col("what") == step)
            known += [scratch.put(below(rows, known), "done"), anchored(rows)]
    return _union([terminals.select(*out_cols), *known]), scratch


def comment_hierarchy(posts: DataFrame, comments: DataFrame, with_paths: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Each comment's root and depth, and with paths the ids down to it.

    Columns ``node`` (``t1_`` id), ``root`` (``t3_`` or ``t1_`` id, or
    ``cycle``), ``depth`` (long), ``path``: from the root to the comment; null
    on cycles. A comment hangs on its parent_id, or on its link_id where that
    is null or blank, if the named record exists; else it is a root of depth
    0. Rows with null or blank id are ignored; of differing copies the newest
    decides; extra columns are ignored; empty tables are fine.
    """
    scratch = Scratch(comments.sparkSession, "parents")
    ref = scratch.put(parent_key(comments).select(F.concat(F.lit("t1_"), "comment_id").alias("node"), F.col("target").alias("parent")), "ref")
    there = posts.select(F.concat(F.lit("t3_"), bare_id(F.col("id"))).alias("key")).where("key is not null").distinct().unionByName(ref.select(F.col("node").alias("key")))
    state = scratch.put(ref.join(there, F.col("parent") == F.col("key"), "left").select("node", F.col("key").alias("parent")), "state")
    path = lambda c: [c.alias("path")] if with_paths else []
    on_post = F.col("parent").startswith("t3_")
    root = F.when(F.col("parent").isNull(), F.col("node")).otherwise(F.col("parent"))
    ends = state.where(F.col("parent").isNull() | on_post).select(
        "node", root.alias("root"), F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"), *path(F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("parent", "node")))
    )
    edges = state.where(F.col("parent").startswith("t1_"))
    done, _ = resolve_forest(edges, ends, with_paths, local_edges)
    return done


def descendants(paths: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for all pairs on a path.

    ``paths``: ``node, path`` as from comment_hierarchy with paths. The size is
    the sum of depths; nodes on cycles have none.
    """
    flat = paths.where("path is not null").select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return flat.where("pos < n - 1").select("ancestor", "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))


def descendant_counts(paths: DataFrame) -> DataFrame:
    """``node, n_descendants, height`` for every record with a reply below it."""
    return descendants(paths).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
