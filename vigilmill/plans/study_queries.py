"""Queries over the recall, cleaning, flattening and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import author_hash, bare_id, record_id
from ..functions.text import iso_utc, squeeze
from ..operators import context, extractions, localize, recall, records, tables, targeted
from ..operators.dedup import keep_one_delivery
from ..operators.flatten import FlatAnswers
from ..sources.slices import year_slices
from .tables import table

SALT = b"vigilmill-test-salt"
START, END = 1672531200, 1735689600  # 2023-01-01 to 2025-01-01
LABELS = {"tormagliflozin": "托格列净", "pelvagliflozin": "佩格列净"}


def names(spark, d):
    return recall.alias_map(table(spark, d, "drug_aliases"))


def targets(spark, d):
    return list(names(spark, d))


def _copies(df, *cols):
    """Delivered copies: ``doc_id`` names a copy, ``id`` its record."""
    key = F.concat_ws("\u001f", bare_id(F.col("id")), F.xxhash64(*[f"`{c}`" for c in df.columns]).cast("string"))
    return df.select(key.alias("doc_id"), bare_id(F.col("id")).alias("id"), "retrieved_on", records.community(F.col("subreddit")).alias("subreddit"), *cols).where("id is not null")


def post_copies(spark, d):
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit("")))
    return _copies(table(spark, d, "posts"), records.seconds(F.col("created_utc")).alias("created_utc"), F.greatest(F.coalesce("num_comments", F.lit(0)), F.lit(0)).alias("num_comments"), text.alias("text"))


def comment_copies(spark, d):
    return _copies(table(spark, d, "comments"), F.coalesce("body", F.lit("")).alias("text"))


def recalled_posts(spark, d, class_only=False):
    return recall.recalled_once(post_copies(spark, d), names(spark, d), class_only)


def recall_exact_matches(spark, d):
    return recall.matches_once(post_copies(spark, d), recall.exact_matches(post_copies(spark, d), names(spark, d))).select("id", "canonical_drug", "matched_text", "matched_alias").withColumnRenamed("id", "doc_id")


def recall_exact_by_drug(spark, d):
    return recall_exact_matches(spark, d).groupBy("canonical_drug").agg(F.count(F.lit(1)).alias("n_records"))


def recall_fuzzy_vocabulary(spark, d):
    words = post_copies(spark, d).select(F.explode(recall.tokens(F.col("text"))).alias("token")).distinct()
    return recall.token_candidates(words, names(spark, d)).select("token", "canonical_drug", "matched_alias", "edit_distance", "similarity")


def recall_full_policy(spark, d):
    got = recalled_posts(spark, d).select(F.col("id").alias("doc_id"), F.explode("drug_match_details").alias("m"))
    return got.select("doc_id", "m.*")


def recall_comments(spark, d):
    return recall.by_drug(recall.recalled_once(comment_copies(spark, d), names(spark, d)))


def recall_mention_sets(spark, d):
    return recall.by_mention_set(recalled_posts(spark, d, True))


def recall_match_flags(spark, d):
    return recall.match_flags(recalled_posts(spark, d, True))


def recall_matched_terms(spark, d):
    return recall.matched_terms(recalled_posts(spark, d))


def recall_rate_by_community(spark, d):
    scope = post_copies(spark, d).select(F.col("id").alias("doc_id"), "subreddit")
    return recall.recall_rate(scope, recalled_posts(spark, d).select(F.col("id").alias("doc_id"), "subreddit"), "subreddit")


def recall_by_community(spark, d):
    return recalled_posts(spark, d).groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_records"), F.sum("num_comments").cast("long").alias("n_comments"))


def recall_in_period(spark, d):
    """Recall within the study period only: the filter precedes the match."""
    scope = post_copies(spark, d).where((F.col("created_utc") >= START) & (F.col("created_utc") < END))
    return recall.by_drug(recall.recalled_once(scope, names(spark, d)))


def recall_top_n(spark, d):
    return recalled_posts(spark, d).select(F.col("id").alias("doc_id"), "subreddit", "created_utc").orderBy("subreddit", F.col("created_utc").asc_nulls_first(), "doc_id").limit(50)


def scan_stats(spark, d):
    """What a recall went through: copies read, records in scope, records recalled."""
    return recall.scan_stats(post_copies(spark, d), recalled_posts(spark, d, True))


def class_term_posts(spark, d):
    return post_copies(spark, d).where(recall.class_term_hit(F.col("text"))).select(F.col("id").alias("doc_id")).distinct()


def year_slices_plan(spark, d):
    return year_slices(spark, START + 86400 * 40, END + 86400 * 100)


def time_range_scan(spark, d):
    return table(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))).select("event_id", "user_id", "event_type")


def normalized_whitespace(spark, d):
    return table(spark, d, "events").select("event_id", squeeze(F.concat(F.lit("  "), "event_type", F.lit(" \t\n "), "props", F.lit(" "))).alias("text"))


def record_id_hash(spark, d):
    made = record_id([F.lit(None).cast("string")], [F.col("user_id").cast("string"), F.col("event_type"), F.lit(""), F.col("props")])
    return table(spark, d, "events").select("event_id", made.alias("record_id"))


def author_hmac(spark, d):
    return table(spark, d, "posts").select(bare_id(F.col("id")).alias("post_id"), author_hash(F.col("author"), SALT).alias("author_hash")).where("post_id is not null").distinct()


def created_iso(spark, d):
    return table(spark, d, "posts").select(bare_id(F.col("id")).alias("post_id"), iso_utc(records.seconds(F.col("created_utc"))).alias("created")).where("post_id is not null").distinct()


_ORDER = ["record_id", "created_utc", "message", "thread_id", "parent_id", "subreddit", "source_type", "user_id"]


def model_rows(spark, d):
    return records.post_rows(table(spark, d, "posts"), SALT).unionByName(records.comment_rows(table(spark, d, "comments"), SALT))


def clean_records(spark, d):
    return records.clean(model_rows(spark, d), _ORDER).select("record_id", "source_type", "thread_id", "parent_id", "subreddit", "date", F.md5(F.encode("message", "UTF-8")).alias("message_md5"))


def clean_audit(spark, d):
    return records.audit(model_rows(spark, d), _ORDER)


def clean_summary(spark, d):
    return records.clean(model_rows(spark, d), _ORDER).groupBy("source_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


def clean_limit(spark, d):
    return records.clean(model_rows(spark, d), _ORDER).orderBy(*_ORDER).limit(100).select("record_id", "source_type")


def thread_context(spark, d):
    got = context.comment_context(table(spark, d, "posts"), table(spark, d, "comments"))
    return got.select("comment_id", "n_ancestors", F.md5(F.encode("context", "UTF-8")).alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


def union_posts_comments(spark, d):
    p = table(spark, d, "posts").select(F.lit("post").alias("source_type"), records.community(F.col("subreddit")).alias("subreddit"))
    c = table(spark, d, "comments").select(F.lit("comment").alias("source_type"), records.community(F.col("subreddit")).alias("subreddit"))
    return p.unionByName(c).groupBy("source_type", "subreddit").agg(F.count(F.lit(1)).alias("n_rows"))


def semi_selected_comments(spark, d):
    """Comments under recalled posts."""
    sel = recalled_posts(spark, d).select(F.col("id").alias("thread"))
    c = keep_one_delivery(table(spark, d, "comments")).select(F.col("id").alias("comment_id"), bare_id(F.col("link_id")).alias("thread"))
    return c.join(sel, "thread", "left_semi").select("comment_id", F.col("thread").alias("post_id"))


def targeted_input(spark, d):
    """Recalled posts and all comments of their threads, with the posts' drugs."""
    rec = recalled_posts(spark, d).select("id", "matched_target_drugs")
    got = targeted.targeted_rows(table(spark, d, "posts"), table(spark, d, "comments"), rec, SALT, with_context=False)
    return got.select("record_id", "source_type", "thread_id", F.array_join("recalled_target_drugs", " + ").alias("drugs"))


def targeted_input_selected(spark, d):
    """Recalled posts and the recalled comments of their threads, each with its own drugs."""
    rec = recalled_posts(spark, d).select("id", "matched_target_drugs")
    said = keep_one_delivery(table(spark, d, "comments")).withColumn("doc_id", F.col("id"))
    said = said.join(rec.select(F.col("id").alias("post")), bare_id(F.col("link_id")) == F.col("post"), "left_semi")
    chosen = recall.recalled(said.select("doc_id", "id", F.coalesce("body", F.lit("")).alias("text")), names(spark, d)).select("id", "matched_target_drugs")
    got = targeted.targeted_rows(table(spark, d, "posts"), table(spark, d, "comments"), rec, SALT, chosen, with_context=False)
    return got.where("source_type = 'comment'").select("record_id", "thread_id", F.array_join("recalled_target_drugs", " + ").alias("drugs"))


def anti_missing_records(spark, d):
    """Records in the extraction log that no table holds."""
    log = extractions.latest_per_record(table(spark, d, "post_extractions")).select("record_id")
    ids = table(spark, d, "posts").select(bare_id(F.col("id")).alias("record_id")).unionByName(table(spark, d, "comments").select(bare_id(F.col("id")).alias("record_id")))
    return log.join(ids.where("record_id is not null").distinct(), "record_id", "left_anti")


def log(spark, d):
    return table(spark, d, "post_extractions")


def log_latest(spark, d):
    return extractions.latest_per_record(log(spark, d)).select("record_id", "log_line", "status", "model_name")


def log_pending(spark, d):
    rows = keep_one_delivery(table(spark, d, "posts")).select(F.col("id").alias("record_id"))
    return extractions.pending(rows, log(spark, d))


def regimens_merged(spark, d):
    return extractions.merged_regimens(FlatAnswers(log(spark, d)), targets(spark, d)).select("log_line", "exposure_group", "n_target_drugs", "regimen_pos")


def events_normalized(spark, d):
    e = extractions.normal_events(FlatAnswers(log(spark, d)), targets(spark, d))
    return e.select("log_line", "exposure_group", "original_expression", "meddra_pt", "meddra_pt_zh", "onset", "severity", "outcome", "confidence")


def study(spark, d):
    return extractions.Study(log(spark, d), targets(spark, d), table(spark, d, "meddra_pt"))


def flatten_posts(spark, d):
    return study(spark, d).posts()


def flatten_exposures(spark, d):
    return study(spark, d).exposures()


def flatten_events(spark, d):
    return study(spark, d).events().select("record_id", "user_id", "subreddit", "exposure_group", "group_type", "n_target_drugs", "original_expression", "proposed_meddra_pt", "meddra_pt_zh", "onset", "severity", "outcome", "confidence")


def pt_validation(spark, d):
    return study(spark, d).events().groupBy("proposed_meddra_pt", "meddra_pt_code", "validated_meddra_pt", "meddra_validation").agg(F.count(F.lit(1)).alias("n_events"))


def group_summary(spark, d):
    s = study(spark, d)
    return tables.group_summary(s.exposures(), s.events())


def term_frequency(spark, d):
    s = study(spark, d)
    return tables.term_frequency(s.exposures(), s.events())


def top10_terms_per_group(spark, d):
    return tables.top_terms(term_frequency(spark, d)).select("exposure_group", "meddra_pt", "n_users", "term_rank")


def symptom_pairs(spark, d):
    s = study(spark, d)
    return tables.symptom_pairs(s.exposures(), s.events())


def exclusive_users(spark, d):
    return tables.exclusive_counts(study(spark, d).exposures(), targets(spark, d))


def exclusive_term_pivot(spark, d):
    s = study(spark, d)
    return tables.exclusive_pivot(s.exposures(), s.events(), targets(spark, d))


def localized_summary(spark, d):
    return localize.chinese(group_summary(spark, d), LABELS, rename=False).select("exposure_group", "group_type", "n_target_drugs", "n_records", "n_exposed_users", "n_event_users")


def extractor_offline(spark, d):
    """The offline extractor over all cleaned posts, back through flattening."""
    rows = records.clean(records.post_rows(table(spark, d, "posts"), SALT), _ORDER)
    symptoms = extractions.term_names(table(spark, d, "meddra_pt"))
    out = extractions.extract(rows, extractions.keyword_extractor(names(spark, d), symptoms), targets(spark, d), "keywords")
    return out.groupBy("status", "model_name").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {f.__name__: f for f in (
    recall_exact_by_drug, recall_exact_matches, recall_fuzzy_vocabulary, recall_full_policy, recall_comments, recall_mention_sets, recall_match_flags, recall_matched_terms, recall_rate_by_community, recall_by_community, recall_in_period, recall_top_n, scan_stats,
    class_term_posts, year_slices_plan, time_range_scan, normalized_whitespace, record_id_hash, author_hmac, created_iso, clean_records, clean_audit, clean_summary, clean_limit, thread_context, union_posts_comments,
    semi_selected_comments, targeted_input, targeted_input_selected, anti_missing_records, log_latest, log_pending, regimens_merged, events_normalized, flatten_posts, flatten_exposures, flatten_events, pt_validation, group_summary, term_frequency, top10_terms_per_group,
    symptom_pairs, exclusive_users, exclusive_term_pivot, localized_summary, extractor_offline,
)}
