"""References to records that do not exist.

A reference is a composite key whose columns may be null. References are
grouped by null mask, and each mask is joined on its non-null columns only, so
every join is a plain equi-join that Spark can hash, sort and split. Declared
match semantics follow SQL foreign keys:

* ``simple``: a reference with any null column is satisfied;
* ``full``: all columns null is satisfied, some null is a violation;
* ``partial``: the non-null columns must match some target row.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, free_name
from .forum import comment_references, delivery_state


def null_mask(keys: list[str]) -> Column:
    """Bit k is set where column k is null."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])


def resolve_references(refs: DataFrame, targets: DataFrame, keys: list[str], payload: list[str] = (), match: str = "partial", masks: list[int] | None = None) -> DataFrame:
    """``refs`` plus ``ref_status`` and the target's ``payload`` columns.

    ``ref_status`` is ``found``, ``missing`` (the anti-join of its mask),
    ``satisfied`` (nothing to look up under the match semantics) or
    ``violation`` (partly null under ``full``). Targets are made unique on
    each mask's columns first, so no reference row multiplies; where partial
    keys hit several targets, each payload column is the smallest value.

    ``masks`` limits the masks that get a join to those that can occur: a
    statement about the data model. A reference of another mask fails the job,
    so none is lost.

    Each mask has an anti-join for what is missing and an inner join for what
    is found, on the same shuffled sides, which Spark computes once.

    Cases: null keys as declared above; repeated references stay repeated;
    empty ``refs`` or ``targets`` give no rows or all ``missing``; columns of
    ``targets`` other than keys and payload are ignored; where ``refs`` has a
    column named like the status or a payload column, the new one gets
    underscores appended.

    A hot key is a matter of the join: ``refs`` is the streamed side of an
    outer equi-join, which adaptive execution splits by size, and the target
    side has one row a key.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    mask = free_name("_mask", refs.columns)
    status = free_name("ref_status", refs.columns)
    out = {p: free_name(p, [*refs.columns, status]) for p in payload}
    inner = {p: f"_p{i}" for i, p in enumerate(payload)}
    n, every = len(keys), (1 << len(keys)) - 1
    wanted = sorted(masks if masks is not None else {sum(b << i for i, b in enumerate(bits)) for bits in product((0, 1), repeat=n)})
    tagged = refs.withColumn(mask, null_mask(keys))
    if masks is not None:
        known = F.col(mask).isin(wanted)
        tagged = tagged.withColumn(mask, F.when(known, F.col(mask)).otherwise(F.raise_error(F.concat(F.lit("a reference has the undeclared null mask "), F.col(mask).cast("string"))).cast("int")))
    none = [F.lit(None).cast(targets.schema[p].dataType).alias(out[p]) for p in payload]
    parts = []
    for m in wanted:
        own = tagged.where(F.col(mask) == m).drop(mask)
        on = [k for i, k in enumerate(keys) if not m >> i & 1]
        fixed = "satisfied" if m == every or (m and match == "simple") else "violation" if m and match == "full" else None
        if fixed:
            parts.append(own.select("*", F.lit(fixed).alias(status), *none))
            continue
        names = {k: f"_t{i}" for i, k in enumerate(on)}
        side = targets.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])).select(*[F.col(k).alias(names[k]) for k in on], *[F.col(p).alias(inner[p]) for p in payload])
        side = side.groupBy(*names.values()).agg(*[F.min(p).alias(p) for p in inner.values()]) if payload else side.distinct()
        cond = reduce(lambda a, b: a & b, [own[k] == side[names[k]] for k in on])
        parts.append(own.join(side, cond, "left_anti").select("*", F.lit("missing").alias(status), *none))
        got = own.join(side, cond)
        parts.append(got.select(*[own[c] for c in own.columns], F.lit("found").alias(status), *[side[inner[p]].alias(out[p]) for p in payload]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "partial") -> DataFrame:
    """The rows of ``refs`` that break the reference (see resolve_references)."""
    status = free_name("ref_status", refs.columns)
    return resolve_references(refs, targets, keys, match=match).where(F.col(status).isin("missing", "violation")).drop(status)


def forum_orphans(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Dangling references of comments, with their target and kind.

    Columns ``comment_id, ref_field, target_table, target, kind, first_on``.

    The reference is the composite key (post_id, comment_id): a link or parent
    sets one of the two and leaves the other null, so two null masks occur and
    each is matched with one table only. kind is ``missing``, ``deleted`` or
    ``late``, the first that applies. Rows with a null or blank id, and blank
    references, are ignored. Empty tables give no rows (no comments) or all
    ``missing`` (no targets).
    """
    # Written once: each mask reads both sides twice, for its anti-join and its inner join.
    scratch = Scratch(comments.sparkSession, "orphans")
    refs = comment_references(comments).withColumnRenamed("target_comment_id", "ref_comment_id").withColumnRenamed("post_id", "ref_post_id").withColumnRenamed("first_on", "own_first_on")
    refs = scratch.put(refs, "refs")
    p, c = delivery_state(posts, "selftext"), delivery_state(comments, "body")
    none = F.lit(None).cast("string")
    withdrawn = F.col("withdrawn").cast("int").alias("withdrawn")
    targets = p.select(F.col("id").alias("ref_post_id"), none.alias("ref_comment_id"), "first_on", withdrawn).unionByName(c.select(none.alias("ref_post_id"), F.col("id").alias("ref_comment_id"), "first_on", withdrawn))
    targets = scratch.put(targets, "targets")
    every = resolve_references(refs, targets, ["ref_post_id", "ref_comment_id"], ["first_on", "withdrawn"], masks=[0b01, 0b10])
    kind = F.when(F.col("ref_status") == "missing", F.lit("missing")).when(F.col("withdrawn") == 1, F.lit("deleted")).when(F.col("first_on") > F.col("own_first_on"), F.lit("late"))
    table = F.when(F.col("ref_post_id").isNotNull(), F.lit("posts")).otherwise(F.lit("comments"))
    return every.select("comment_id", "ref_field", table.alias("target_table"), F.coalesce("ref_post_id", "ref_comment_id").alias("target"), kind.alias("kind"), F.col("own_first_on").alias("first_on")).where(F.col("kind").isNotNull())


def orphans_per_comment(found: DataFrame) -> DataFrame:
    """One row per comment id and reference: of differing copies the most
    severe kind counts (missing, deleted, late)."""
    rank = F.when(F.col("kind") == "missing", 0).when(F.col("kind") == "deleted", 1).otherwise(2)
    return found.groupBy("comment_id", "ref_field").agg(F.min(rank).alias("r")).select("comment_id", "ref_field", F.element_at(F.array(F.lit("missing"), F.lit("deleted"), F.lit("late")), F.col("r") + 1).alias("kind"))


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Counts per referenced table and month of the comment's first delivery.

    ``month`` is ``unknown`` where no copy of the comment has a delivery time.
    """
    month = F.coalesce(F.date_format(F.timestamp_seconds("first_on"), "yyyy-MM"), F.lit("unknown"))
    return found.groupBy("target_table", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("target").alias("n_targets"))
