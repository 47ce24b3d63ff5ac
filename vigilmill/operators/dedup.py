"""One copy of each message that was delivered more than once.

Whole rows are costly to move and few identifiers have several. So the first
step looks at identifier and delivery time only: its buffers have fixed width,
which lets Spark use hash aggregation with map-side partials. Rows of
identifiers with one copy then pass as they are; of the others, only rows of
the best delivery time go through ``min_by`` over a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bare_id
from ..session import Scratch, free_name

#: Identifiers with several copies that are sent to every task (about 50 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def repeated_ids(keyed: DataFrame, key: str, at: Column) -> DataFrame:
    """``key, _best, n_copies`` of keys with several rows; ``_best`` is the
    least ``at`` (null last). All buffers are longs."""
    narrow = keyed.select(F.col(f"`{key}`").alias(key), F.coalesce(at, F.lit(2**62)).alias("_at"))
    return narrow.groupBy(key).agg(F.min("_at").alias("_best"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def keep_one_delivery(df: DataFrame, id_col: str = "id", delivered_col: str = "retrieved_on", keep: str = "first", keep_null_ids: bool = False, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Exactly one row per identifier, plus ``n_copies``.

    ``keep`` is ``first`` (earliest delivery, null times last) or ``last``
    (latest, null times lowest). Ties go to the row that is least by its own
    columns in order, nulls first (columns that can't be ordered as JSON
    text), so the result doesn't depend on partitioning.

    The id is compared without blanks and type prefix; the kept row's id
    column has the bare form. Rows with null or blank id can't be told apart
    and are dropped, or all kept with ``keep_null_ids`` (n_copies 1). Exact
    repeats count as copies. Extra columns are kept; where one is named
    ``n_copies``, the count is ``n_copies_`` and so on. Empty tables give none.

    An id with a third of all rows moves as one row a task in both steps; no
    window, no collected group. The list of repeated ids is written first; it
    is broadcast up to ``broadcast_ids`` ids, so that rows of single copies
    are not shuffled, and joined by shuffle beyond. ``df`` is read twice: write
    it first where it is costly to compute.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep}")
    key, count, best = (free_name(n, df.columns) for n in ("_key", "n_copies", "_row"))
    keyed = df.withColumn(key, bare_id(F.col(f"`{id_col}`")))
    there = keyed.where(F.col(key).isNotNull())
    at = F.col(f"`{delivered_col}`").cast("long")
    at = at if keep == "first" else -at
    again = Scratch(df.sparkSession, "repeated").put(repeated_ids(there, key, at).select(F.col(key).alias("_k"), "_best", F.col("n_copies").alias("_n")))
    again = F.broadcast(again) if again.count() <= broadcast_ids else again.hint("shuffle_hash")
    same = F.col(key) == F.col("_k")
    bare = lambda r: [(bare_id(F.col(f"{r}`{c}`")) if c == id_col else F.col(f"{r}`{c}`")).alias(c) for c in df.columns]
    alone = there.join(again, same, "left_anti").select(*bare(""), F.lit(1).cast("long").alias(count))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ties = F.struct(*[F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])
    tied = there.join(again, same & (F.coalesce(at, F.lit(2**62)) == F.col("_best")))
    kept = tied.groupBy("_k", "_n").agg(F.min_by(row, F.struct(at.alias("at"), ties.alias("ties"))).alias(best))
    # The id comes from the kept row, not from the key: the choice can't be pruned away.
    out = alone.unionByName(kept.select(*bare(f"{best}."), F.col("_n").alias(count)))
    if keep_null_ids:
        out = out.unionByName(keyed.where(F.col(key).isNull()).drop(key).withColumn(count, F.lit(1).cast("long")))
    return out
