"""Posts and comments as delivered: ids, references and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bare_id, prefixed_id, record_kind
from ..functions.text import is_withdrawn


def delivery_state(df: DataFrame, text_col: str) -> DataFrame:
    """Per id: first delivery, and whether the newest copy is withdrawn.

    Columns ``id, first_on, withdrawn``. All aggregate buffers are longs, so
    Spark uses hash aggregation with map-side partials: an id that holds a
    third of all rows shrinks to one row per task before the shuffle. Newest
    means greatest ``retrieved_on``, null lowest; of equally new copies a
    withdrawn one decides.
    """
    flag = is_withdrawn(F.col(text_col)).cast("long")
    return (
        df.select(bare_id(F.col("id")).alias("id"), "retrieved_on", flag.alias("w"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("retrieved_on").alias("first_on"), F.max(F.coalesce(F.col("retrieved_on"), F.lit(-(2**60))) * 2 + F.col("w")).alias("k"))
        .select("id", "first_on", (F.pmod("k", F.lit(2)) == 1).alias("withdrawn"))
    )


def reference_struct(c: Column, field: str) -> Column:
    """(ref_field, post_id, comment_id) with exactly one of the ids set."""
    kind, target = record_kind(c, "post"), bare_id(c)
    return F.when(
        target.isNotNull(),
        F.struct(
            F.lit(field).alias("ref_field"),
            F.when(kind == "post", target).alias("post_id"),
            F.when(kind == "comment", target).alias("comment_id"),
        ),
    )


def comment_references(comments: DataFrame) -> DataFrame:
    """Rows ``comment_id, ref_field, post_id, target_comment_id, first_on``.

    One row per distinct comment id and reference; ``first_on`` is the first
    delivery of the comment itself.
    """
    refs = F.array_compact(F.array(reference_struct(F.col("link_id"), "link_id"), reference_struct(F.col("parent_id"), "parent_id")))
    by_id = (
        comments.select(bare_id(F.col("id")).alias("cid"), "retrieved_on", refs.alias("refs"))
        .where(F.col("cid").isNotNull())
        .groupBy("cid")
        .agg(F.min("retrieved_on").alias("first_on"), F.collect_set("refs").alias("sets"))
    )
    flat = by_id.select("cid", "first_on", F.explode(F.array_distinct(F.flatten("sets"))).alias("r"))
    return flat.select(F.col("cid").alias("comment_id"), "r.ref_field", "r.post_id", F.col("r.comment_id").alias("target_comment_id"), "first_on")


def parent_key(comments: DataFrame) -> DataFrame:
    """Rows ``comment_id, target``: where a comment hangs, one row per id.

    ``target`` is the prefixed id from parent_id, or from link_id where
    parent_id is null or blank; null if both are. Of differing copies the
    newest decides (null ``retrieved_on`` lowest, then the greater target).
    """
    target = F.coalesce(prefixed_id(F.col("parent_id"), "post"), prefixed_id(F.col("link_id"), "post"))
    rows = comments.select(bare_id(F.col("id")).alias("comment_id"), target.alias("target"), F.coalesce(F.col("retrieved_on"), F.lit(-(2**60))).alias("on"))
    return rows.where(F.col("comment_id").isNotNull()).groupBy("comment_id").agg(F.max(F.struct("on", "target")).alias("m")).select("comment_id", F.col("m.target").alias("target"))
