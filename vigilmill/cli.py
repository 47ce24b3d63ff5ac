"""Command line: python -m vigilmill.cli STAGE ...

Stages: plan, ingest, threads, recall, recall-comments, clean, extract,
statistics. Each reads and writes tables;
everything between is one lazy DataFrame.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import extractions, recall, records, tables
from .operators.context import comment_context
from .operators.dedup import keep_one_delivery
from .functions.ids import bare_id
from .sources import jobs, readers, sinks
from .sources.forum_api import day
from .sources.slices import plan_jobs
from .streaming.extraction_log import run_pending


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vigilmill")
    sub = p.add_subparsers(dest="stage", required=True)

    def period(s):
        s.add_argument("--subreddits", nargs="+", default=[])
        s.add_argument("--start-date", required=True)
        s.add_argument("--end-date", required=True)

    s = sub.add_parser("plan")
    period(s)
    s.add_argument("--kinds", nargs="+", default=["posts", "comments"], choices=["posts", "comments"])
    s = sub.add_parser("ingest")
    period(s)
    s.add_argument("--url", required=True)
    s.add_argument("--kind", default="posts", choices=["posts", "comments"])
    s.add_argument("--output", required=True)
    s.add_argument("--page-size", type=int, default=100)
    s.add_argument("--request-delay", type=float, default=0.8)
    s.add_argument("--timeout", type=float, default=120)
    s.add_argument("--max-retries", type=int, default=0)
    s = sub.add_parser("recall")
    s.add_argument("--posts", required=True)
    s.add_argument("--drug-alias-file", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--include-class-only", action="store_true")
    s.add_argument("--max-recalled-posts", type=int)
    s.add_argument("--refresh-recall", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("clean")
    s.add_argument("--posts", required=True)
    s.add_argument("--comments", required=True)
    s.add_argument("--salt-file", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--limit", type=int)
    s = sub.add_parser("threads")
    s.add_argument("--recall", required=True)
    s.add_argument("--start-date", required=True)
    s.add_argument("--end-date", required=True)
    s.add_argument("--url", required=True)
    s.add_argument("--output", required=True)
    s = sub.add_parser("recall-comments")
    s.add_argument("--recall", required=True)
    s.add_argument("--comments", required=True)
    s.add_argument("--drug-alias-file", required=True)
    s.add_argument("--output", required=True)
    s = sub.add_parser("extract")
    s.add_argument("--input", required=True)
    s.add_argument("--drug-alias-file", required=True)
    s.add_argument("--meddra-pt", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--tasks", type=int)
    s.add_argument("--concurrency", type=int, default=4)
    s.add_argument("--restart", action="store_true")
    s = sub.add_parser("statistics")
    s.add_argument("--log", required=True)
    s.add_argument("--target-drugs", nargs="+", required=True)
    s.add_argument("--meddra-pt")
    s.add_argument("--drug-labels-zh")
    s.add_argument("--min-chart-users", type=int, default=1)
    s.add_argument("--output", required=True)
    return p


def report_failures(failed) -> None:
    """End with an error that names some of the failed jobs, if there are any."""
    some = failed.limit(5).collect()
    if some:
        raise SystemExit(f"{failed.count()} jobs failed, such as " + "; ".join(f"{r[0]}: {r[1]}" for r in some))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.stage == "plan":
        plan_jobs(spark, a.subreddits, a.kinds, day(a.start_date), day(a.end_date)).orderBy("job_no").show(1000, False)
    elif a.stage == "ingest":
        if not 1 <= a.page_size <= 100 or a.request_delay < 0 or a.timeout <= 0 or day(a.start_date) >= day(a.end_date):
            raise SystemExit("page size is 1 to 100, delay 0 or more, timeout positive, start before end")
        options = {"url": a.url, "pageSize": str(a.page_size), "delay": str(a.request_delay), "timeout": str(a.timeout), "maxRetries": str(a.max_retries)}
        with sinks.folder_lock(a.output):
            report_failures(jobs.ingest_jobs(spark, jobs.slice_jobs(plan_jobs(spark, a.subreddits, [a.kind], day(a.start_date), day(a.end_date))), a.output, options, a.kind))
    elif a.stage == "threads":
        posts = spark.read.parquet(f"{a.recall}/manifest").select(F.col("id").alias("post_id"), "created_utc")
        with sinks.folder_lock(a.output):
            report_failures(jobs.ingest_jobs(spark, jobs.thread_jobs(posts, day(a.start_date), day(a.end_date)), a.output, {"url": a.url}, "comments"))
    elif a.stage == "recall-comments":
        names = recall.alias_map(readers.alias_table(spark, a.drug_alias_file))
        posts = spark.read.parquet(f"{a.recall}/manifest").select("id")
        c = keep_one_delivery(spark.read.parquet(a.comments))
        own = c.join(posts.select(F.col("id").alias("post")), bare_id(F.col("link_id")) == F.col("post"), "left_semi")
        texts = own.select(F.col("id").alias("doc_id"), "id", bare_id(F.col("link_id")).alias("post_id"), F.coalesce("body", F.lit("")).alias("text"))
        # The post recall's fingerprint ties the comments' manifest to it.
        parameters = {"names": names, "posts": sinks.content_fingerprint(posts, ["id"])}
        summary = sinks.write_recall(recall.recalled(texts, names).drop("text"), a.output, parameters)
        print(json.dumps({k: summary[k] for k in ("n_records", "by_drug")}))
    elif a.stage == "extract":
        names = recall.alias_map(readers.alias_table(spark, a.drug_alias_file))
        extractor = extractions.keyword_extractor(names, extractions.term_names(readers.term_dictionary(spark, a.meddra_pt)))
        with sinks.folder_lock(f"{a.output}.lock"):
            print(run_pending(spark.read.parquet(a.input), a.output, extractor, list(names), "keywords", a.tasks, a.restart, a.concurrency, extractions.backoff), "lines appended")
    elif a.stage == "recall":
        names = recall.alias_map(readers.alias_table(spark, a.drug_alias_file))
        parameters = {"names": names, "similarity": config.FUZZY_SIMILARITY, "class_only": a.include_class_only, "limit": a.max_recalled_posts, "posts": a.posts}
        if not a.refresh_recall and not a.dry_run and sinks.saved_recall(spark, a.output, parameters) is not None:
            print("the saved recall has the same parameters")
            return
        posts = spark.read.parquet(a.posts)
        text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit("")))
        key = F.concat_ws("/", bare_id(F.col("id")), F.xxhash64(*posts.columns).cast("string"))
        copies = posts.select(key.alias("doc_id"), bare_id(F.col("id")).alias("id"), "retrieved_on", records.community(F.col("subreddit")).alias("subreddit"), records.seconds(F.col("created_utc")).alias("created_utc"), text.alias("text")).where("id is not null")
        got = recall.recalled_once(copies, names, a.include_class_only).withColumn("doc_id", F.col("id")).orderBy("subreddit", "created_utc", "id")
        got = got.limit(a.max_recalled_posts) if a.max_recalled_posts else got
        if a.dry_run:
            recall.by_drug(got).show()
        else:
            summary = sinks.write_recall(got.drop("text"), a.output, parameters)
            print(json.dumps({k: summary[k] for k in ("n_records", "by_drug")}))
    elif a.stage == "clean":
        with open(a.salt_file, "rb") as f:
            salt = f.read()
        posts, comments = spark.read.parquet(a.posts), spark.read.parquet(a.comments)
        ctx = comment_context(posts, comments).select(F.col("comment_id").alias("record_id"), F.col("context").alias("ctx"))
        c = records.comment_rows(comments, salt).join(ctx, "record_id", "left").withColumn("context", F.coalesce("ctx", F.lit(""))).drop("ctx")
        order = ["record_id", "created_utc", "message", "thread_id", "parent_id", "subreddit", "source_type", "user_id"]
        rows = records.post_rows(posts, salt).unionByName(c)
        kept = records.clean(rows, order)
        (kept.orderBy(*order).limit(a.limit) if a.limit else kept).write.mode("overwrite").parquet(f"{a.output}/cleaned")
        sinks.write_json(records.audit(rows, order).first().asDict(), f"{a.output}/audit.json")
    else:
        targets = list(dict.fromkeys(t.strip().casefold() for t in a.target_drugs if t.strip()))
        log = spark.read.parquet(a.log)
        terms = readers.term_dictionary(spark, a.meddra_pt) if a.meddra_pt else None
        labels = readers.drug_labels(a.drug_labels_zh, targets, config.DRUG_LABELS_ZH)
        study = extractions.Study(log, targets, terms)
        exp, ev = study.exposures().cache(), study.events().cache()
        freq = tables.term_frequency(exp, ev)
        out = {"group_summary": tables.group_summary(exp, ev).orderBy("n_target_drugs", F.desc("n_exposed_users"), "exposure_group"), "term_frequency": freq.orderBy("n_target_drugs", "exposure_group", F.desc("n_users"), "meddra_pt"), "exposures": exp, "events": ev.drop("ordinal")}
        for name, df in out.items():
            sinks.write_bilingual(df, f"{a.output}/tables/{name}.csv", labels)
        sinks.write_csv(tables.symptom_pairs(exp, ev).orderBy(F.desc("n_users"), "symptom_1", "symptom_2"), f"{a.output}/tables/appendix_1_pairs.csv")
        sinks.write_csv(tables.exclusive_pivot(exp, ev, targets).orderBy(F.desc("n_total"), "symptom_zh"), f"{a.output}/tables/appendix_2_exclusive.csv")
        sinks.top_charts(tables.top_terms(freq), f"{a.output}/charts", a.min_chart_users)


if __name__ == "__main__":
    main()
