"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import bare_id
from ..plans.tables import table
from . import leakage, near_duplicates, packing, pii, sentences, visual


def forum_texts(spark, d):
    """``space, id, text`` of posts' and comments' main texts, ids bare."""
    p = table(spark, d, "posts").select(F.lit("posts").alias("space"), bare_id(F.col("id")).alias("id"), F.col("selftext").alias("text"))
    c = table(spark, d, "comments").select(F.lit("comments").alias("space"), bare_id(F.col("id")).alias("id"), F.col("body").alias("text"))
    return p.unionByName(c)


def p4_found(spark, d):
    members = visual.look_alike_classes(forum_texts(spark, d))
    return visual.look_alike_pairs(members).withColumnRenamed("space", "table_name")


def p4_classes(spark, d):
    members = visual.look_alike_classes(forum_texts(spark, d))
    return members.select(F.col("space").alias("table_name"), "id", F.col("raw").alias("text_md5"), F.col("key").alias("form_md5"))


def p4_consistent_texts(spark, d):
    return visual.consistent_texts(forum_texts(spark, d).withColumnRenamed("space", "table_name"), "text")


def personal_texts(spark, d):
    """``key`` (table_name, id, field_name), ``text``: title, selftext, body.

    Copies of an id with equal text are one row; differing copies stay.
    """
    parts = []
    for t, fields in (("posts", ("title", "selftext")), ("comments", ("body",))):
        src = table(spark, d, t)
        for f in fields:
            parts.append(src.select(F.struct(F.lit(t).alias("table_name"), bare_id(F.col("id")).alias("id"), F.lit(f).alias("field_name")).alias("key"), F.col(f).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key.id is not null")


def p5_found(spark, d):
    got = pii.personal_spans(personal_texts(spark, d))
    # A copy that was delivered again shows the same occurrence again.
    return got.select("key.table_name", "key.id", "key.field_name", "pii_type", "start_pos").distinct()


def p5_masked(spark, d):
    got = pii.masked_texts(personal_texts(spark, d))
    return got.select("key.table_name", "key.id", "key.field_name", "masked")


def p6_found(spark, d):
    return near_duplicates.NearDuplicates(forum_texts(spark, d)).pairs().withColumnRenamed("space", "table_name")


def p6_classes(spark, d):
    got = near_duplicates.NearDuplicates(forum_texts(spark, d)).members()
    return got.select(F.col("space").alias("table_name"), "id", F.lower(F.hex("key")).alias("class_key"))


def p6_class_links(spark, d):
    got = near_duplicates.NearDuplicates(forum_texts(spark, d)).links()
    return got.select(F.col("space").alias("table_name"), F.lower(F.hex("key_a")).alias("class_a"), F.lower(F.hex("key_b")).alias("class_b"), "similarity")


def p6_groups(spark, d):
    """One row per document and word set, with its group: classes connected by links."""
    return near_duplicates.NearDuplicates(forum_texts(spark, d)).groups().withColumnRenamed("space", "table_name")


def p6_link_counts(spark, d):
    return near_duplicates.NearDuplicates(forum_texts(spark, d)).link_counts().withColumnRenamed("space", "table_name")


def p8_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_fill(spark, d):
    return packing.fill_report(p8_packing(spark, d))


def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_passages(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), spans=True)


def p9_clean_documents(spark, d):
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "start_pos", "end_pos")


def p10_sentences(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"), with_text=True, keep=("lang",)).select("doc_id", "unit_no", "lang", "unit")


QUERIES = {
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p4_consistent_texts": p4_consistent_texts,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_class_links": p6_class_links,
    "p6_groups": p6_groups,
    "p6_link_counts": p6_link_counts,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p9_clean_documents": p9_clean_documents,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
}
_ID = "nullif(trim(regexp_replace(trim(id), '^t[13]_', '')), '')"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_FROM = visual.BLANKS + _WIDE + "".join(visual.LOOKALIKE) + visual.PLAIN_HYPHEN
_TO = " " * len(visual.BLANKS) + "".join(chr(c) for c in range(0x21, 0x7F)) + "".join(visual.LOOKALIKE.values()) + "-" * len(visual.PLAIN_HYPHEN)
_HIDDEN = "[\\p{Cf}" + visual.INVISIBLE + "\\x{FE00}-\\x{FE0F}]+"
_JOINED = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬆ": "st", "µ": "μ"}


def _look(text: str) -> str:
    """The plain path to what a text looks like: every look-alike is Latin."""
    out = f"nfc_normalize({text})"
    for a, b in _JOINED.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(nfc_normalize(translate(regexp_replace({out}, {_quoted(_HIDDEN)}, '', 'g'), {_quoted(_FROM)}, {_quoted(_TO)})), ' ')"


_RUNS = "regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+')"
SQL: dict[str, str] = {
    "p4_found": f"""WITH t AS (SELECT 'posts' AS table_name, {_ID} AS id, selftext AS text FROM posts UNION SELECT 'comments', {_ID}, body FROM comments),
k AS (SELECT DISTINCT table_name, id, text, {_look('text')} AS look FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
several AS (SELECT table_name, look FROM k WHERE look <> '' GROUP BY 1, 2 HAVING count(DISTINCT text) > 1),
m AS (SELECT k.* FROM k JOIN several USING (table_name, look))
SELECT DISTINCT a.table_name, a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.table_name = b.table_name AND a.look = b.look AND a.id < b.id AND a.text <> b.text""",
    "p6_found": f"""WITH t AS (SELECT 'posts' AS table_name, {_ID} AS id, selftext AS text FROM posts UNION SELECT 'comments', {_ID}, body FROM comments),
l AS (SELECT table_name, id, regexp_extract_all(lower({_look('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT table_name, id, list_distinct(w) AS w FROM l WHERE len(w) >= 40),
u AS (SELECT DISTINCT table_name, id, w, len(w) AS n FROM s),
k AS (SELECT row_number() OVER () AS rid, * FROM u), x AS (SELECT rid, table_name, n, unnest(w) AS word FROM k),
f AS (SELECT word, count(*) AS c FROM x GROUP BY word),
p AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY rid ORDER BY c, word) AS rk FROM x JOIN f USING (word)) WHERE rk <= n - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.rid AS ra, b.rid AS rb FROM p a JOIN p b ON a.word = b.word AND a.table_name = b.table_name AND a.rid < b.rid AND a.n >= 0.75 * b.n AND b.n >= 0.75 * a.n),
v AS (SELECT a.table_name, a.id AS x, b.id AS y, len(list_intersect(a.w, b.w)) AS i, a.n AS na, b.n AS nb FROM c JOIN k a ON a.rid = ra JOIN k b ON b.rid = rb)
SELECT DISTINCT table_name, least(x, y) AS id_a, greatest(x, y) AS id_b FROM v WHERE x <> y AND i >= 0.75 * (na + nb - i) - 1e-9""",
    "p9_found": f"""WITH i AS (SELECT item_id, coalesce(lower(lang), '') LIKE 'zh%' AS zh, {_RUNS} AS w FROM eval_items), d AS (SELECT doc_id, {_RUNS} AS w FROM documents),
ig AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE NOT zh)),
dg AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
ic AS (SELECT item_id, r[p:p + 23] AS g FROM (SELECT item_id, array_to_string(w, '') AS r, unnest(range(1, length(array_to_string(w, '')) - 22)) AS p FROM i WHERE zh)),
dc AS (SELECT doc_id, array_to_string(w, '') AS r FROM d WHERE regexp_matches(array_to_string(w, ''), '[\\x{{3400}}-\\x{{9fff}}]'))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g) UNION SELECT DISTINCT item_id, doc_id FROM ic JOIN dc ON contains(r, g)""",
}
