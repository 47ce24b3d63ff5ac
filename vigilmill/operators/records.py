"""Model input rows: assembly, cleaning, pseudonyms, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_MESSAGE_CHARS
from ..functions.ids import author_hash, bare_id, prefixed_id, record_id
from ..functions.text import first_chars, iso_utc, squeeze

COLUMNS = ["record_id", "user_id", "message", "context", "title", "source_type", "thread_id", "parent_id", "subreddit", "created_utc", "date"]
GONE = ["", "[deleted]", "[removed]", "deleted", "removed"]


def community(c: Column) -> Column:
    """Lower case, without blanks and ``r/``."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^/?r/", "")


def seconds(c: Column) -> Column:
    """Epoch seconds; milliseconds are scaled down, zero and less is null."""
    s = c.cast("double").try_cast("bigint")
    return F.when(s >= 100_000_000_000, F.floor(s / 1000).cast("long")).when(s > 0, s)


def post_rows(posts: DataFrame, salt: bytes) -> DataFrame:
    """Posts as model input; title and text are joined into the message."""
    text = F.concat_ws("\n\n", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), F.nullif(F.coalesce("selftext", F.lit("")), F.lit("")))
    i = bare_id(F.col("id"))
    at = seconds(F.col("created_utc"))
    return posts.where(i.isNotNull()).select(
        i.alias("record_id"), author_hash(F.col("author"), salt).alias("user_id"), first_chars(text, MAX_MESSAGE_CHARS).alias("message"), F.lit("").alias("context"), F.lit("").alias("title"),
        F.lit("post").alias("source_type"), i.alias("thread_id"), F.lit("").alias("parent_id"), community(F.col("subreddit")).alias("subreddit"), at.alias("created_utc"), iso_utc(at).alias("date"),
    )


def comment_rows(comments: DataFrame, salt: bytes) -> DataFrame:
    """Comments as model input; ``context`` is added by add_context."""
    i = bare_id(F.col("id"))
    at = seconds(F.col("created_utc"))
    return comments.where(i.isNotNull()).select(
        i.alias("record_id"), author_hash(F.col("author"), salt).alias("user_id"), first_chars(F.coalesce("body", F.lit("")), MAX_MESSAGE_CHARS).alias("message"), F.lit("").alias("context"), F.lit("").alias("title"),
        F.lit("comment").alias("source_type"), F.coalesce(bare_id(F.col("link_id")), F.lit("")).alias("thread_id"), F.coalesce(prefixed_id(F.col("parent_id"), "post"), F.lit("")).alias("parent_id"),
        community(F.col("subreddit")).alias("subreddit"), at.alias("created_utc"), iso_utc(at).alias("date"),
    )


def tidied(rows: DataFrame) -> DataFrame:
    """Input rows with tidy text columns, a record id, and ``stage``:
    ``invalid_text``, ``missing_user`` or null. Needed columns that are absent
    count as empty; without user_id, or message and body, it is an error."""
    if "user_id" not in rows.columns:
        raise ValueError("the input has no column user_id")
    if "message" not in rows.columns:
        if "body" not in rows.columns:
            raise ValueError("the input has neither message nor body")
        rows = rows.withColumn("message", F.col("body"))
    for c in ("context", "title", "subreddit", "date"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    rows = rows.withColumns({c: squeeze(F.col(c)) for c in ("user_id", "message", "context", "title", "subreddit", "date")})
    rows = rows.withColumn("message", F.trim(F.when(F.col("title") != "", F.concat("title", F.lit("\n\n"), "message")).otherwise(F.col("message"))))
    given = [squeeze(F.col(c)) for c in ("record_id", "post_id", "id") if c in rows.columns]
    rows = rows.withColumn("record_id", record_id(given, [F.col(c) for c in ("user_id", "subreddit", "date", "message")]))
    return rows.withColumn("stage", F.when(F.lower("message").isin(GONE), "invalid_text").when(F.lower("user_id").isin("", "[deleted]", "deleted"), "missing_user"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order`` (then by all columns).

    An aggregation, not a window: a key with a third of all rows shrinks to
    one row per task before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])


def clean_steps(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tidied rows; valid rows once per record; those once per user and text."""
    tidy = tidied(rows)
    once = first_of(tidy.where("stage is null").drop("stage"), ["record_id"], order)
    return tidy, once, first_of(once, ["user_id", "message"], order)


def clean(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with text and user, once per record, then once per user and text.

    ``order`` are columns that say which of equal rows comes first. Nulls
    count as empty text; repeated rows count as duplicates; extra columns stay.
    """
    return clean_steps(rows, order)[2]


def audit(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: input, removed at each stage, and output rows."""
    tidy, once, last = clean_steps(rows, order)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    counts = [
        tidy.agg(F.count(F.lit(1)).alias("a"), n(F.col("stage") == "invalid_text").alias("b"), n(F.col("stage") == "missing_user").alias("c"), zero.alias("d"), zero.alias("e")),
        once.agg(zero.alias("a"), zero.alias("b"), zero.alias("c"), F.count(F.lit(1)).alias("d"), zero.alias("e")),
        last.agg(zero.alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d"), F.count(F.lit(1)).alias("e")),
    ]
    t = counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[F.sum(c).alias(c) for c in "abcde"])
    return t.select(
        F.col("a").alias("input_rows"), F.col("b").alias("removed_invalid_or_empty_text"), F.col("c").alias("removed_missing_or_deleted_user"),
        (F.col("a") - F.col("b") - F.col("c") - F.col("d")).alias("removed_duplicate_record_id"), (F.col("d") - F.col("e")).alias("removed_duplicate_user_text"), F.col("e").alias("output_rows_before_limit"),
    )


def user_prompt(context: Column) -> Column:
    """The text a model gets for a row (columns record_id, subreddit, date, message)."""
    c = squeeze(context)
    block = F.when(c != "", F.concat(F.lit("<thread_context>\n"), c, F.lit("\n</thread_context>\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("record_id: "), "record_id", F.lit("\nsubreddit: "), "subreddit", F.lit("\ndate: "), "date", F.lit("\n"), block, F.lit("<focal_text>\n"), "message", F.lit("\n</focal_text>"))
