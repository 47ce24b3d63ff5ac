"""Thread context of comments: the post and the nearest earlier replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_ANCESTORS, MAX_CONTEXT_CHARS, POST_LABEL, REPLY_LABEL
from ..functions.ids import bare_id, prefixed_id
from ..functions.text import last_chars, squeeze
from ..session import Scratch
from .dedup import keep_one_delivery
from .hierarchy import resolve_forest


def comment_context(posts: DataFrame, comments: DataFrame, ancestors: int = MAX_ANCESTORS, limit: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """``comment_id, n_ancestors, context`` for every comment.

    The context is the post's text, then up to ``ancestors`` earlier replies
    from the oldest down, skipping empty and withdrawn ones without counting
    them; it keeps the last ``limit`` characters. The walk ends at a post, at
    a missing parent, and where it would visit a comment twice.

    Withdrawn comments are first contracted away (each one gets its nearest
    speaking ancestor, by resolve_forest), so the walk is exactly
    ``ancestors`` joins on unique ids, however deep the thread.
    """
    scratch = Scratch(comments.sparkSession, "context")
    latest = keep_one_delivery(comments, keep="last")
    body = squeeze(F.col("body"))
    c = scratch.put(
        latest.select(F.col("id").alias("cid"), bare_id(F.col("link_id")).alias("thread"), prefixed_id(F.col("parent_id"), "post").alias("p"), body.alias("body"), F.lower(body).isin("", "[deleted]", "[removed]").alias("mute"))
        .select("cid", "thread", F.when(F.col("p").startswith("t1_"), F.substring("p", 4, 1_000_000)).alias("parent"), "body", "mute")
    )
    there = c.select(F.col("cid").alias("k"), F.col("mute").alias("parent_mute"))
    up = scratch.put(c.select("cid", "parent", "mute").join(there, F.col("parent") == F.col("k"), "left").select("cid", "mute", F.col("k").alias("parent"), "parent_mute"))
    # A mute comment stands for its nearest speaking ancestor; none: null.
    speaking = up.where("not mute").select(F.col("cid").alias("node"), F.col("cid").alias("root"), F.lit(0).cast("long").alias("depth"))
    orphan = up.where("mute and parent is null").select(F.col("cid").alias("node"), F.lit("").alias("root"), F.lit(0).cast("long").alias("depth"))
    edges = up.where("mute and parent is not null").select(F.col("cid").alias("node"), "parent")
    stand, _ = resolve_forest(edges, speaking.unionByName(orphan))
    stand = scratch.put(stand.join(up.where("mute").select("cid"), F.col("node") == F.col("cid"), "left_semi").select("node", F.when(F.col("root").isin("", "cycle"), F.lit(None)).otherwise(F.col("root")).alias("stand")))
    above = scratch.put(up.where("parent is not null").join(stand, F.col("parent") == F.col("node"), "left").select("cid", F.when(F.col("parent_mute"), F.col("stand")).otherwise(F.col("parent")).alias("up")).where("up is not null"))
    # Level n holds the comments that have an n-th ancestor, so levels shrink and no join sees a null key.
    level = above.select("cid", F.col("up").alias("at"), F.array("up").alias("seen"))
    levels = [level.select("cid", F.lit(0).alias("n"), F.col("at").alias("a"))]
    for n in range(1, ancestors):
        step = above.select(F.col("cid").alias("at"), "up")
        level = level.join(step, "at").where(~F.array_contains("seen", F.col("up"))).select("cid", F.col("up").alias("at"), F.concat("seen", F.array("up")).alias("seen"))
        level = scratch.put(level)
        levels.append(level.select("cid", F.lit(n).alias("n"), F.col("at").alias("a")))
    every = reduce(lambda x, y: x.unionByName(y), levels)
    said = every.join(c.select(F.col("cid").alias("a"), F.col("body").alias("said")), "a")
    # At most ``ancestors`` bodies a comment.
    replies = said.groupBy("cid").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("n", "said")))), lambda x: F.concat(F.lit(REPLY_LABEL + "\n"), x["said"])).alias("replies"))
    post = keep_one_delivery(posts, keep="last").select(F.col("id").alias("thread"), F.concat_ws("\n\n", F.nullif(squeeze(F.col("title")), F.lit("")), F.nullif(squeeze(F.col("selftext")), F.lit(""))).alias("post"))
    got = c.select("cid", "thread").join(post, "thread", "left").join(replies, "cid", "left")
    none = F.array().cast("array<string>")
    blocks = F.concat(F.when(F.coalesce("post", F.lit("")) != "", F.array(F.concat(F.lit(POST_LABEL + "\n"), "post"))).otherwise(none), F.coalesce("replies", none))
    return got.select(F.col("cid").alias("comment_id"), F.size(F.coalesce("replies", none)).alias("n_ancestors"), last_chars(F.array_join(blocks, "\n\n"), limit).alias("context"))
