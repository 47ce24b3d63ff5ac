"""Resumable ingestion of slices and threads.

A job is a paged query with a period: a slice of a community, or a thread by
its ``link_id``. Jobs run as rows of a table, some at a time. Each group of
jobs is written as a numbered part, then its jobs are noted in the state table:
a part without state is overwritten by the next run, so a crash at any point
loses nothing and repeats nothing. A failed job is noted with its error, and the
others go on. A finished job is taken up again from its newest second when its
period has grown.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bare_id
from ..operators.dedup import keep_one_delivery
from ..schemas import COMMENT, POST
from ..session import Scratch
from .forum_api import MOST_PAGE, _typed, epoch, pages

STATE = "job_id string, part int, done_to bigint, newest bigint, n_items bigint, error string"


def slice_jobs(plan: DataFrame) -> DataFrame:
    """Jobs of planned slices (community, kind, start_at, end_at)."""
    return plan.select(F.concat_ws("/", "kind", F.lower("community"), F.col("start_at").cast("string")).alias("job_id"), F.create_map(F.lit("subreddit"), F.col("community")).alias("query"), F.col("start_at").alias("start"), F.col("end_at").alias("end"))


def thread_jobs(posts: DataFrame, start: int, end: int) -> DataFrame:
    """Jobs of threads (``post_id``, ``created_utc`` seconds or null): from the
    post's time on, but not before ``start``. One job a thread."""
    p = posts.where("post_id is not null").groupBy("post_id").agg(F.min("created_utc").cast("long").alias("at"))
    return p.select(F.concat(F.lit("thread/"), "post_id").alias("job_id"), F.create_map(F.lit("link_id"), F.col("post_id")).alias("query"), F.greatest(F.coalesce("at", F.lit(start)), F.lit(start)).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))


def _run(options: dict[str, str], fields: list[tuple[str, str]], endpoint: str):
    names = [n for n, _ in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, cls = options.get("transport", "vigilmill.sources.forum_api:HttpTransport").partition(":")
        transport = getattr(importlib.import_module(module), cls)(dict(options))
        size, pause = min(int(options.get("pageSize", MOST_PAGE)), MOST_PAGE), float(options.get("delay", "0.8"))
        for pdf in frames:
            for job in pdf.itertuples():
                def ask(sort: str, job=job):
                    def fetch(after: int, before: int) -> list[dict]:
                        return transport.get(endpoint, {**dict(job.query), "after": after, "before": before, "sort": sort, "limit": size, "fields": ",".join(names)})

                    return fetch

                rows, newest, error = [], None, None
                try:
                    for item in pages(ask("asc"), int(job.start), int(job.end), size, lambda: time.sleep(pause), ask("desc")):
                        rows.append(_typed(item, fields))
                        newest = max(newest or 0, epoch(item) or 0)
                except Exception as e:  # noqa: BLE001 - a failed job is noted, the others go on
                    rows, newest, error = [], None, f"{type(e).__name__}: {e}"
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "job_id", job.job_id)
                out["_newest"], out["_error"], out["_n"] = None, None, None
                mark = pd.DataFrame([[job.job_id, *[None] * len(names), newest, error, len(rows)]], columns=[*out.columns])
                yield out
                yield mark

    return run


def state(spark: SparkSession, path: str) -> DataFrame:
    """One row a job: the last one noted."""
    if not os.path.exists(f"{path}/_state"):
        return spark.createDataFrame([], STATE)
    s = spark.read.schema(STATE).parquet(f"{path}/_state")
    return s.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in s.columns if c != "job_id"]), "part").alias("s")).select("job_id", "s.*")


def ingested(spark: SparkSession, path: str, kind: str = "posts") -> DataFrame:
    """The records of all parts that are noted, each id once."""
    schema = (COMMENT if kind == "comments" else POST) + ", job_id string, part int"
    if not os.path.exists(f"{path}/_state"):
        return spark.createDataFrame([], schema)
    parts = spark.read.schema(STATE).parquet(f"{path}/_state").select("part").distinct()
    return spark.read.schema(schema).parquet(f"{path}/data").join(F.broadcast(parts), "part", "left_semi")  # one row a part


def ingest_jobs(spark: SparkSession, jobs: DataFrame, path: str, options: dict[str, str], kind: str = "posts", at_once: int = 500) -> DataFrame:
    """Run what is pending of ``jobs`` (job_id, query, start, end).

    Returns the failed jobs of this call (job_id, error). Records that were
    stored before, and repeats, are left out; of threads also records without
    id. Data without state, and a folder made with other settings, are refused.
    """
    settings = {"kind": kind, "url": options.get("url", "")}
    os.makedirs(path, exist_ok=True)
    note = f"{path}/_settings.json"
    if os.path.exists(note):
        with open(note, encoding="utf-8") as f:
            if (was := json.load(f)) != settings:
                raise ValueError(f"the folder was made with other settings: {was}")
    elif os.path.exists(f"{path}/data"):
        raise ValueError("the folder holds data without its state")
    else:
        with open(note, "w", encoding="utf-8") as f:
            json.dump(settings, f)
    fields = [(c.split()[0], c.split()[1]) for c in (COMMENT if kind == "comments" else POST).split(", ")]
    schema = "job_id string, " + ", ".join(f"{n} {k}" for n, k in fields) + ", _newest bigint, _error string, _n bigint"
    scratch = Scratch(spark, "jobs")
    failed: list[DataFrame] = []
    tried = spark.createDataFrame([], "job_id string")
    while True:
        had = state(spark, path)
        todo = jobs.join(tried, "job_id", "left_anti").join(had.select("job_id", "done_to", F.col("newest").alias("_from")), "job_id", "left").where("done_to is null or done_to < `end`")
        todo = todo.select("job_id", "query", F.greatest("start", F.coalesce("_from", "start")).alias("start"), "end").orderBy("job_id").limit(at_once)
        todo = scratch.put(todo, "todo")
        n = todo.count()
        if not n:
            break
        part = int(had.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0]) + 1
        got = scratch.put(todo.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(_run(options, fields, f"{kind}/search"), schema), "got")
        marks = got.where("_n is not null")
        items = got.where("_n is null").drop("_newest", "_error", "_n").withColumn("id", bare_id(F.col("id")))
        own = keep_one_delivery(items, "id", "retrieved_on", keep_null_ids=True).drop("n_copies")
        stored = ingested(spark, path, kind).select("id").where("id is not null").distinct()
        new = own.where("id is not null").join(stored, "id", "left_anti").select(*items.columns)
        loose = own.where("id is null and not startswith(job_id, 'thread/')")
        new.unionByName(loose).write.mode("overwrite").parquet(f"{path}/data/part={part}")
        noted = marks.join(todo.select("job_id", "end"), "job_id").select("job_id", F.lit(part).alias("part"), F.when(F.col("_error").isNull(), F.col("end")).alias("done_to"), F.col("_newest").alias("newest"), F.col("_n").alias("n_items"), F.col("_error").alias("error"))
        noted.coalesce(1).write.mode("append").parquet(f"{path}/_state")  # at most at_once rows
        failed.append(marks.where("_error is not null").select("job_id", F.col("_error").alias("error")))
        tried = tried.unionByName(todo.select("job_id"))
    out = spark.createDataFrame([], "job_id string, error string")
    for f in failed:
        out = out.unionByName(f)
    return out


