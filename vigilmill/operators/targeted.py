"""Recalled posts and the comments of their threads as model-ready rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bare_id
from ..session import Scratch
from . import records
from .context import comment_context
from .dedup import keep_one_delivery


def _checked(df: DataFrame, bad: Column, text: str) -> DataFrame:
    """``df``; a row for which ``bad`` holds fails the job."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(text + ": "), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("null")))).isNull()).otherwise(F.lit(True)))


def manifest(recalled: DataFrame, id_col: str) -> DataFrame:
    """``id, drugs`` of a recall; a blank or repeated id fails the job."""
    m = recalled.select(bare_id(F.col(id_col)).alias("id"), F.col("matched_target_drugs").alias("drugs"))
    m = m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("drugs").alias("drugs"))
    return _checked(m, F.col("id").isNull() | (F.col("n") > 1), "blank or repeated id in the recall").drop("n")


def targeted_rows(posts: DataFrame, comments: DataFrame, recalled_posts: DataFrame, salt: bytes, recalled_comments: DataFrame | None = None, with_context: bool = True) -> DataFrame:
    """Rows for the model, with ``recalled_target_drugs``.

    ``recalled_posts``: ``id, matched_target_drugs``. All comments of their
    threads come along with the post's drugs; with ``recalled_comments``
    (``id, matched_target_drugs``) only those, with their own. A recalled
    record that the tables lack fails the job. Empty recalls give no rows.
    """
    scratch = Scratch(posts.sparkSession, "targeted")
    posts, comments = keep_one_delivery(posts).drop("n_copies"), keep_one_delivery(comments).drop("n_copies")
    wanted = scratch.put(manifest(recalled_posts, "id"), "posts")
    p = records.post_rows(posts, salt).withColumn("_id", bare_id(F.col("record_id")))
    got_posts = scratch.put(wanted.join(p, F.col("id") == F.col("_id"), "left"), "own")
    own = _checked(got_posts, F.col("record_id").isNull(), "a recalled post is missing").drop("id", "_id")
    c = records.comment_rows(comments, salt).withColumn("_id", bare_id(F.col("record_id")))
    post_drugs = wanted.select(F.col("id").alias("_thread"), F.col("drugs").alias("_post_drugs"))
    c = c.join(post_drugs, bare_id(F.col("thread_id")) == F.col("_thread"))
    if recalled_comments is not None:
        few = scratch.put(manifest(recalled_comments, "id"), "comments").select(F.col("id").alias("_own"), "drugs")
        c = scratch.put(few.join(c, F.col("_own") == F.col("_id"), "left"), "selected")
        c = _checked(c, F.col("record_id").isNull(), "a recalled comment is missing").drop("_own").withColumn("drugs", F.coalesce("drugs", "_post_drugs"))
    else:
        c = c.withColumn("drugs", F.col("_post_drugs"))
    c = c.drop("_thread", "_post_drugs")
    if with_context:
        ctx = comment_context(posts, comments).select(F.col("comment_id").alias("_id"), F.col("context").alias("_ctx"))
        c = c.join(ctx, "_id", "left").withColumn("context", F.coalesce("_ctx", F.lit(""))).drop("_ctx")
    out = own.unionByName(c.drop("_id"))
    return out.withColumnRenamed("drugs", "recalled_target_drugs")
