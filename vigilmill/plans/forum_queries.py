"""Queries p1, p2, p3 and p7, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, flatten, hierarchy, orphans
from .tables import table


def p1_found(spark, d):
    return orphans.orphans_per_comment(orphans.forum_orphans(table(spark, d, "posts"), table(spark, d, "comments")))


def p1_orphans_by_month(spark, d):
    return orphans.orphans_by_month(orphans.forum_orphans(table(spark, d, "posts"), table(spark, d, "comments")))


def _answers(kind):
    return lambda spark, d: flatten.flat_answers(table(spark, d, "post_extractions"), kind)


def p3_found(spark, d):
    parts = [dedup.keep_one_delivery(table(spark, d, t)).where("n_copies > 1").select(F.lit(t).alias("table_name"), "id", "n_copies") for t in ("posts", "comments")]
    return parts[0].unionByName(parts[1])


def p3_posts_once(spark, d):
    return dedup.keep_one_delivery(table(spark, d, "posts"))


def p3_comments_once(spark, d):
    return dedup.keep_one_delivery(table(spark, d, "comments"))


def p7_found(spark, d):
    h = hierarchy.comment_hierarchy(table(spark, d, "posts"), table(spark, d, "comments"))
    return h.select(F.substring("node", 4, 1_000_000).alias("comment_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("node_depth"))


def p7_rounds(spark, d):
    """p7_found with every round distributed: none is left to one task."""
    h = hierarchy.comment_hierarchy(table(spark, d, "posts"), table(spark, d, "comments"), local_edges=0)
    return h.select(F.substring("node", 4, 1_000_000).alias("comment_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("node_depth"))


def p7_paths(spark, d):
    h = hierarchy.comment_hierarchy(table(spark, d, "posts"), table(spark, d, "comments"), with_paths=True)
    return h.select(F.col("node").alias("record_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("node_depth"), F.array_join("path", "/").alias("path"))


def p7_descendants(spark, d):
    h = hierarchy.comment_hierarchy(table(spark, d, "posts"), table(spark, d, "comments"), with_paths=True)
    return hierarchy.descendants(h)


def p7_descendant_counts(spark, d):
    h = hierarchy.comment_hierarchy(table(spark, d, "posts"), table(spark, d, "comments"), with_paths=True)
    return hierarchy.descendant_counts(h)


QUERIES = {
    "p1_found": p1_found,
    "p1_orphans_by_month": p1_orphans_by_month,
    "p2_found": _answers("item"),
    "p2_records": _answers("record"),
    "p2_regimens": _answers("regimen"),
    "p2_drugs": _answers("drug"),
    "p2_adverse_events": _answers("event"),
    "p2_evidence": _answers("evidence"),
    "p3_found": p3_found,
    "p3_posts_once": p3_posts_once,
    "p3_comments_once": p3_comments_once,
    "p7_found": p7_found,
    "p7_rounds": p7_rounds,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
    "p7_descendant_counts": p7_descendant_counts,
}

_ID = "nullif(trim(regexp_replace(trim({0}), '^t[13]_', '')), '')"
_STATE = f"""
b AS (SELECT {_ID.format('id')} AS cid, retrieved_on, body, trim(link_id) AS l, trim(parent_id) AS p FROM comments),
pb AS (SELECT {_ID.format('id')} AS pid, retrieved_on, selftext FROM posts),
st AS (
 SELECT 'posts' AS k, pid AS id, min(retrieved_on) AS first_on, max(coalesce(retrieved_on, -1000000000000) * 2 + CASE WHEN lower(trim(selftext)) IN ('[deleted]', '[removed]') THEN 1 ELSE 0 END) AS z FROM pb WHERE pid IS NOT NULL GROUP BY pid
 UNION ALL
 SELECT 'comments', cid, min(retrieved_on), max(coalesce(retrieved_on, -1000000000000) * 2 + CASE WHEN lower(trim(body)) IN ('[deleted]', '[removed]') THEN 1 ELSE 0 END) FROM b WHERE cid IS NOT NULL GROUP BY cid),
refs AS (
 SELECT DISTINCT cid, 'link_id' AS ref_field, CASE WHEN l LIKE 't1|_%' ESCAPE '|' THEN 'comments' ELSE 'posts' END AS k, trim(regexp_replace(l, '^t[13]_', '')) AS target FROM b WHERE cid IS NOT NULL AND l <> ''
 UNION
 SELECT DISTINCT cid, 'parent_id', CASE WHEN p LIKE 't1|_%' ESCAPE '|' THEN 'comments' ELSE 'posts' END, trim(regexp_replace(p, '^t[13]_', '')) FROM b WHERE cid IS NOT NULL AND p <> ''),
kinds AS (
 SELECT r.cid, r.ref_field, r.k, r.target, o.first_on, CASE WHEN t.id IS NULL THEN 0 WHEN abs(t.z) % 2 = 1 THEN 1 WHEN t.first_on > o.first_on THEN 2 END AS r
 FROM refs r LEFT JOIN st t ON t.k = r.k AND t.id = r.target JOIN st o ON o.k = 'comments' AND o.id = r.cid WHERE r.target <> '')"""
_KIND = "CASE {0} WHEN 0 THEN 'missing' WHEN 1 THEN 'deleted' ELSE 'late' END"
_TREE = f"""
raw AS (SELECT {_ID.format('id')} AS cid, coalesce(retrieved_on, -1152921504606846976) AS t,
  coalesce(CASE WHEN trim(parent_id) LIKE 't1|_%' ESCAPE '|' THEN 't1_' ELSE 't3_' END || {_ID.format('parent_id')}, CASE WHEN trim(link_id) LIKE 't1|_%' ESCAPE '|' THEN 't1_' ELSE 't3_' END || {_ID.format('link_id')}) AS target FROM comments),
ref AS (SELECT 't1_' || cid AS node, target FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY t DESC, target DESC NULLS LAST) AS rn FROM raw WHERE cid IS NOT NULL) WHERE rn = 1),
there AS (SELECT DISTINCT 't3_' || {_ID.format('id')} AS k FROM posts UNION SELECT node FROM ref),
link AS (SELECT node, k AS parent FROM ref LEFT JOIN there ON target = k),
walk AS (
 SELECT node, coalesce(parent, node) AS root, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN parent IS NULL THEN [node] ELSE [parent, node] END AS path FROM link WHERE parent IS NULL OR parent LIKE 't3|_%' ESCAPE '|'
 UNION ALL
 SELECT l.node, w.root, w.depth + 1, list_append(w.path, l.node) FROM link l JOIN walk w ON l.parent = w.node)"""


def _once(t: str, cols: str) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in cols.split(", "))
    kept = cols.replace("id", "k AS id", 1)
    return f"SELECT {kept}, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY retrieved_on NULLS LAST, {order}) AS rn, count(*) OVER (PARTITION BY k) AS n_copies FROM (SELECT *, {_ID.format('id')} AS k FROM {t})) WHERE k IS NOT NULL AND rn = 1"


SQL = {
    "p1_found": f"WITH {_STATE} SELECT cid AS comment_id, ref_field, {_KIND.format('min(r)')} AS kind FROM kinds WHERE r IS NOT NULL GROUP BY cid, ref_field",
    "p1_orphans_by_month": f"WITH {_STATE} SELECT k AS target_table, coalesce(strftime(to_timestamp(first_on) AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS month, {_KIND.format('r')} AS kind, count(*) AS n_references, count(DISTINCT target) AS n_targets FROM kinds WHERE r IS NOT NULL GROUP BY 1, 2, 3",
    "p3_found": " UNION ALL ".join(f"SELECT '{t}' AS table_name, id, n_copies FROM (SELECT {_ID.format('id')} AS id, count(*) AS n_copies FROM {t} GROUP BY 1) WHERE id IS NOT NULL AND n_copies > 1" for t in ("posts", "comments")),
    "p3_posts_once": _once("posts", "id, author, created_utc, retrieved_on, subreddit, title, selftext, score, num_comments, link_flair_text, url"),
    "p3_comments_once": _once("comments", "id, author, created_utc, retrieved_on, subreddit, body, link_id, parent_id, score"),
    "p7_found": f"WITH RECURSIVE {_TREE} SELECT substr(l.node, 4) AS comment_id, coalesce(w.root, 'cycle') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS node_depth FROM link l LEFT JOIN walk w ON l.node = w.node",
    "p7_paths": f"WITH RECURSIVE {_TREE} SELECT l.node AS record_id, coalesce(w.root, 'cycle') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS node_depth, array_to_string(w.path, '/') AS path FROM link l LEFT JOIN walk w ON l.node = w.node",
    "p7_descendants": f"WITH RECURSIVE {_TREE}, flat AS (SELECT node, path, unnest(range(1, len(path))) AS i FROM walk) SELECT path[i] AS ancestor, node AS descendant, CAST(len(path) - i AS INTEGER) AS distance FROM flat",
    "p7_descendant_counts": f"WITH RECURSIVE {_TREE}, flat AS (SELECT path, unnest(range(1, len(path))) AS i FROM walk) SELECT path[i] AS node, count(*) AS n_descendants, CAST(max(len(path) - i) AS INTEGER) AS height FROM flat GROUP BY 1",
}
SQL["p7_rounds"] = SQL["p7_found"]
