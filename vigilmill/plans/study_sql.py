"""SQL for the study queries (DuckDB dialect)."""

from __future__ import annotations

from .study_queries import END, LABELS, SALT, START

_ID = "nullif(trim(regexp_replace(trim({0}), '^t[13]_', '')), '')"
_COMMUNITY = "regexp_replace(lower(trim(coalesce(subreddit, ''))), '^/?r/', '')"
_SECONDS = "CASE WHEN created_utc >= 100000000000 THEN CAST(floor(created_utc / 1000) AS BIGINT) WHEN created_utc > 0 THEN created_utc END"
_POST_COPIES = f"""p1 AS (SELECT *, {_ID.format('id')} AS k FROM posts),
docs AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, k, retrieved_on, {_COMMUNITY} AS subreddit, {_SECONDS} AS created_utc, greatest(coalesce(num_comments, 0), 0) AS num_comments, coalesce(title, '') || chr(10) || coalesce(selftext, '') AS text FROM p1 WHERE k IS NOT NULL)"""
_COMMENT_COPIES = f"""c0 AS (SELECT *, {_ID.format('id')} AS k FROM comments),
docs AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, k, retrieved_on, {_COMMUNITY} AS subreddit, NULL AS created_utc, 0 AS num_comments, coalesce(body, '') AS text FROM c0 WHERE k IS NOT NULL)"""
_COMMENTS_ONCE = f"""c1 AS (SELECT *, {_ID.format('id')} AS k FROM comments),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY retrieved_on NULLS LAST, id NULLS FIRST, author NULLS FIRST, created_utc NULLS FIRST, subreddit NULLS FIRST, body NULLS FIRST, link_id NULLS FIRST, parent_id NULLS FIRST, score NULLS FIRST) AS rn FROM c1 WHERE k IS NOT NULL) WHERE rn = 1)"""
_NAMES = """nm AS (SELECT DISTINCT lower(trim(canonical)) AS drug, a.alias FROM drug_aliases, (SELECT unnest(list_distinct(list_transform(list_append(aliases, canonical), lambda x: lower(trim(x))))) AS alias) a WHERE a.alias <> ''),
pat AS (SELECT drug, string_agg(alias, '|' ORDER BY length(alias) DESC, alias) AS alt FROM nm GROUP BY drug)"""
_EXACT = """exact AS (SELECT doc_id, drug AS canonical_drug, regexp_extract(text, '(?i)(?:^|[^a-z0-9])(' || alt || ')(?:$|[^a-z0-9])', 1) AS matched_text FROM docs, pat WHERE regexp_matches(text, '(?i)(?:^|[^a-z0-9])(' || alt || ')(?:$|[^a-z0-9])'))"""
_FUZZY = """tok AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(?i)[a-z]{7,}'))) AS token FROM docs),
voc AS (SELECT DISTINCT token FROM tok WHERE token NOT IN (SELECT alias FROM nm)),
cand0 AS (SELECT token, drug AS canonical_drug, alias AS matched_alias, damerau_levenshtein(token, alias) AS d, greatest(length(token), length(alias)) AS m FROM voc, nm WHERE length(alias) >= 7 AND regexp_matches(alias, '^[a-z]+$')),
cand AS (SELECT token, canonical_drug, matched_alias, CAST(d AS INTEGER) AS edit_distance, round_even((1.0 - d / m) * 10000.0, 0) / 10000.0 AS similarity FROM cand0 WHERE 1.0 - d / m + 1e-12 >= 0.8)"""
_MATCHES = f"""{_NAMES}, {_EXACT}, {_FUZZY},
open AS (SELECT t.doc_id, t.token, c.* EXCLUDE (token) FROM tok t JOIN cand c USING (token) WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = t.doc_id AND e.canonical_drug = c.canonical_drug)),
top AS (SELECT *, max(similarity) OVER (PARTITION BY doc_id, token) AS best FROM open),
one AS (SELECT doc_id, token, min(canonical_drug) AS canonical_drug FROM top WHERE similarity = best GROUP BY doc_id, token HAVING count(DISTINCT canonical_drug) = 1),
win AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id, t.canonical_drug ORDER BY t.similarity DESC, t.edit_distance, t.token, t.matched_alias) AS rn FROM top t JOIN one o ON o.doc_id = t.doc_id AND o.token = t.token AND o.canonical_drug = t.canonical_drug WHERE t.similarity = t.best),
matches AS (SELECT doc_id, canonical_drug, matched_text, lower(matched_text) AS matched_alias, 'exact' AS match_type, 0 AS edit_distance, CAST(1.0 AS DOUBLE) AS similarity FROM exact
 UNION ALL SELECT doc_id, canonical_drug, token, matched_alias, 'fuzzy', edit_distance, similarity FROM win WHERE rn = 1),
klass AS (SELECT doc_id FROM docs WHERE regexp_matches(text, '(?i)(?:^|[^a-z0-9])(?:gliflozins|gliflozin|sglt 2|sglt-2|sglt2)(?:$|[^a-z0-9])')),
per AS (SELECT doc_id, string_agg(canonical_drug, ' + ' ORDER BY canonical_drug) AS mention_set, count(*) AS n, bool_or(match_type = 'exact') AS ex, bool_or(match_type = 'fuzzy') AS fz FROM matches GROUP BY doc_id),
allper AS (SELECT * FROM per UNION ALL SELECT doc_id, 'class_only', 0, false, false FROM klass WHERE doc_id NOT IN (SELECT doc_id FROM per))"""
_POST_MATCHES = f"WITH {_POST_COPIES}, {_MATCHES}"


def _first(hits: str) -> str:
    """Of each record the first copy among those in ``hits``."""
    return f"first AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY retrieved_on NULLS LAST, subreddit, created_utc NULLS FIRST, num_comments, text) AS rn FROM docs d WHERE doc_id IN (SELECT doc_id FROM {hits})) WHERE rn = 1)"



# The answers: fences and second encodings peeled off, then nested arrays by position.
_FENCE = "CASE WHEN regexp_matches({0}, '^\\s*```') THEN regexp_extract({0}, '(?s)^\\s*```[^`\\n]*\\n?(.*?)\\n?\\s*```\\s*$', 1) ELSE {0} END"
_UNWRAP = "CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END"
_ANSWERS = f"""a0 AS (SELECT *, {_FENCE.format('extraction')} AS t FROM post_extractions WHERE extraction IS NOT NULL),
a1 AS (SELECT * REPLACE ({_UNWRAP.format('t')} AS t) FROM a0), a2 AS (SELECT * REPLACE ({_FENCE.format('t')} AS t) FROM a1), a3 AS (SELECT * REPLACE ({_UNWRAP.format('t')} AS t) FROM a2),
obj AS (SELECT * FROM (SELECT *, CASE WHEN json_valid(t) THEN t END AS j FROM a3) WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
reg0 AS (SELECT log_line, j, unnest(range(CAST(json_array_length(j, '$.regimens') AS BIGINT))) AS regimen_pos FROM obj WHERE json_type(j, '$.regimens') = 'ARRAY'),
reg AS (SELECT * FROM (SELECT log_line, CAST(regimen_pos AS INTEGER) AS regimen_pos, json_extract(j, '$.regimens[' || regimen_pos || ']') AS r FROM reg0) WHERE json_type(r) = 'OBJECT'),
drug0 AS (SELECT log_line, regimen_pos, r, unnest(range(CAST(json_array_length(r, '$.drugs') AS BIGINT))) AS i FROM reg WHERE json_type(r, '$.drugs') = 'ARRAY'),
drug AS (SELECT * FROM (SELECT log_line, regimen_pos, CAST(i AS INTEGER) AS drug_pos, CASE WHEN json_type(r, '$.drugs[' || i || ']') = 'VARCHAR' THEN json_extract_string(r, '$.drugs[' || i || ']') END AS drug FROM drug0) WHERE trim(drug, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
ev0 AS (SELECT log_line, regimen_pos, r, unnest(range(CAST(json_array_length(r, '$.adverse_events') AS BIGINT))) AS i FROM reg WHERE json_type(r, '$.adverse_events') = 'ARRAY'),
ev1 AS (SELECT log_line, regimen_pos, CAST(i AS INTEGER) AS event_pos, json_extract(r, '$.adverse_events[' || i || ']') AS e FROM ev0),
ev AS (SELECT * FROM (SELECT *, CASE WHEN json_type(e, '$.original_expression') = 'VARCHAR' THEN json_extract_string(e, '$.original_expression') END AS original_expression FROM ev1 WHERE json_type(e) = 'OBJECT') WHERE trim(original_expression, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
evid0 AS (SELECT log_line, regimen_pos, event_pos, e, unnest(range(CAST(json_array_length(e, '$.evidence') AS BIGINT))) AS i FROM ev WHERE json_type(e, '$.evidence') = 'ARRAY'),
evid AS (SELECT log_line, regimen_pos, event_pos, CAST(i AS INTEGER) AS evidence_pos, json_extract_string(e, '$.evidence[' || i || '].quote') AS quote, CASE WHEN json_type(e, '$.evidence[' || i || '].pos') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(e, '$.evidence[' || i || '].pos') AS BIGINT) END AS quote_pos FROM evid0 WHERE json_type(e, '$.evidence[' || i || '].quote') = 'VARCHAR')"""


def _field(name: str) -> str:
    return f"CASE WHEN json_type(e, '$.{name}') = 'VARCHAR' THEN json_extract_string(e, '$.{name}') END"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


_TARGETS = "tg AS (SELECT drug, row_number() OVER (ORDER BY drug) AS o FROM (SELECT DISTINCT lower(trim(canonical)) AS drug FROM drug_aliases))"
_CONF = "CASE WHEN json_type(e, '$.confidence') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(json_extract_string(e, '$.confidence') AS DOUBLE) END"
_STUDY = f"""{_ANSWERS}, {_TARGETS},
rx AS (SELECT log_line, regimen_pos, string_agg(drug, ' + ' ORDER BY o) AS exposure_group, CAST(count(*) AS INTEGER) AS n_target_drugs FROM (SELECT DISTINCT log_line, regimen_pos, tg.drug, o FROM drug d JOIN tg ON tg.drug = lower({_tidy('d.drug')})) GROUP BY 1, 2),
merged AS (SELECT log_line, exposure_group, n_target_drugs, min(regimen_pos) AS regimen_pos FROM rx GROUP BY 1, 2, 3),
evn AS (SELECT ev.log_line, rx.exposure_group, rx.n_target_drugs, ev.regimen_pos, event_pos, {_tidy('original_expression')} AS original_expression, {_tidy(_field('meddra_pt'))} AS meddra_pt, {_tidy(_field('meddra_pt_zh'))} AS meddra_pt_zh, {_tidy(_field('onset'))} AS onset, {_tidy(_field('severity'))} AS severity,
  CASE WHEN lower({_tidy(_field('outcome'))}) IN ('resolved', 'improving', 'ongoing', 'worsening', 'unknown') THEN lower({_tidy(_field('outcome'))}) ELSE 'unknown' END AS outcome, least(greatest(coalesce({_CONF}, 0.0), 0.0), 1.0) AS confidence FROM ev JOIN rx USING (log_line, regimen_pos)),
nev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_line, exposure_group, lower(original_expression), lower(meddra_pt), lower(onset) ORDER BY regimen_pos, event_pos) AS rn FROM evn) WHERE rn = 1),
last AS (SELECT * FROM (SELECT *, {_ID.format('record_id')} AS rid, row_number() OVER (PARTITION BY {_ID.format('record_id')} ORDER BY log_line DESC) AS rn FROM post_extractions) WHERE rid IS NOT NULL AND rn = 1),
done AS (SELECT log_line, rid AS record_id, user_id, subreddit, date_text FROM last WHERE status = 'completed'),
expo AS (SELECT d.record_id, d.user_id, d.subreddit, d.date_text, m.exposure_group, CASE WHEN m.n_target_drugs = 1 THEN 'single' ELSE 'combination' END AS group_type, m.n_target_drugs, EXISTS (SELECT 1 FROM nev n WHERE n.log_line = m.log_line AND n.exposure_group = m.exposure_group) AS has_adverse_events FROM merged m JOIN done d USING (log_line)),
pt AS (SELECT k, arg_max(pt_code, pt_code) AS pt_code, arg_max(trim(pt_term), pt_code) AS pt_term FROM (SELECT lower({_tidy('pt_term')}) AS k, pt_code, pt_term FROM meddra_pt WHERE pt_term IS NOT NULL) GROUP BY k),
evt AS (SELECT d.record_id, d.user_id, d.subreddit, n.exposure_group, CASE WHEN n.n_target_drugs = 1 THEN 'single' ELSE 'combination' END AS group_type, n.n_target_drugs, n.original_expression, n.meddra_pt AS proposed_meddra_pt, n.meddra_pt_zh, n.onset, n.severity, n.outcome, n.confidence,
  CASE WHEN n.meddra_pt <> '' THEN pt.pt_code END AS meddra_pt_code, coalesce(CASE WHEN n.meddra_pt <> '' THEN pt.pt_term END, '') AS validated_meddra_pt, CASE WHEN pt.k IS NOT NULL AND n.meddra_pt <> '' THEN 'exact' ELSE 'unmatched' END AS meddra_validation, n.log_line, n.regimen_pos, n.event_pos
  FROM nev n JOIN done d USING (log_line) LEFT JOIN pt ON pt.k = lower(n.meddra_pt)),
term AS (SELECT *, CASE WHEN validated_meddra_pt <> '' THEN validated_meddra_pt ELSE proposed_meddra_pt END AS term FROM evt),
summ AS (SELECT e.exposure_group, e.group_type, e.n_target_drugs, count(DISTINCT e.record_id) AS n_records, count(DISTINCT e.user_id) AS n_exposed_users, (SELECT count(DISTINCT v.user_id) FROM evt v WHERE v.exposure_group = e.exposure_group) AS n_event_users FROM expo e GROUP BY 1, 2, 3),
labels AS (SELECT exposure_group, term, meddra_pt_zh FROM (SELECT *, row_number() OVER (PARTITION BY exposure_group, term ORDER BY n DESC, o) AS rn FROM (SELECT exposure_group, term, meddra_pt_zh, count(*) AS n, min(log_line * 1000000 + regimen_pos * 1000 + event_pos) AS o FROM term WHERE term <> '' AND meddra_pt_zh <> '' GROUP BY 1, 2, 3)) WHERE rn = 1),
glabels AS (SELECT term, meddra_pt_zh FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, o) AS rn FROM (SELECT term, meddra_pt_zh, count(*) AS n, min(log_line * 1000000 + regimen_pos * 1000 + event_pos) AS o FROM term WHERE term <> '' AND meddra_pt_zh <> '' GROUP BY 1, 2)) WHERE rn = 1),
freq AS (SELECT t.exposure_group, t.group_type, t.n_target_drugs, t.term AS meddra_pt, coalesce(l.meddra_pt_zh, '') AS meddra_pt_zh, count(DISTINCT t.user_id) AS n_users, any_value(s.n_exposed_users) AS n_exposed_users, any_value(s.n_event_users) AS n_event_users
  FROM term t LEFT JOIN labels l ON l.exposure_group = t.exposure_group AND l.term = t.term LEFT JOIN summ s ON s.exposure_group = t.exposure_group WHERE t.term <> '' GROUP BY 1, 2, 3, 4, 5),
sym AS (SELECT DISTINCT t.user_id, {_tidy('coalesce(g.meddra_pt_zh, t.term)')} AS s FROM term t LEFT JOIN glabels g USING (term) WHERE t.term <> '' AND t.user_id IN (SELECT user_id FROM expo)),
solo AS (SELECT user_id, min(exposure_group) AS drug FROM expo GROUP BY user_id HAVING count(DISTINCT exposure_group) = 1 AND min(exposure_group) IN (SELECT drug FROM tg)),
nsolo AS (SELECT tg.drug, count(solo.user_id) AS n FROM tg LEFT JOIN solo USING (drug) GROUP BY 1)"""
_W = f"WITH {_STUDY} "

_KEY = SALT.ljust(64, b"\0")
_HMAC = "sha256(from_hex('{0}') || from_hex(sha256(from_hex('{1}') || encode({2}))))".format(bytes(x ^ 0x5C for x in _KEY).hex(), bytes(x ^ 0x36 for x in _KEY).hex(), "{0}")

# Cleaning: the pseudonym is left out, as equal authors are equal pseudonyms.
_AUTHOR = f"CASE WHEN lower({_tidy('author')}) IN ('[deleted]', 'deleted') THEN '' ELSE {_tidy('author')} END"
_ISO = f"coalesce(strftime(to_timestamp({_SECONDS}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00'), '')"
_PARENT = f"coalesce(CASE WHEN trim(parent_id) LIKE 't1|_%' ESCAPE '|' THEN 't1_' ELSE 't3_' END || {_ID.format('parent_id')}, '')"
_TITLED = f"{_tidy('title')}"
_CLEAN = f"""rows0 AS (
 SELECT {_ID.format('id')} AS record_id, {_AUTHOR} AS u, {_tidy("left(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(selftext, '')), 12000)")} AS message, 'post' AS source_type, {_ID.format('id')} AS thread_id, '' AS parent_id, {_COMMUNITY} AS subreddit, {_SECONDS} AS created_utc, {_ISO} AS date FROM posts
 UNION ALL SELECT {_ID.format('id')}, {_AUTHOR}, {_tidy("left(coalesce(body, ''), 12000)")}, 'comment', coalesce({_ID.format('link_id')}, ''), {_PARENT}, {_COMMUNITY}, {_SECONDS}, {_ISO} FROM comments),
s1 AS (SELECT *, CASE WHEN lower(message) IN ('', '[deleted]', '[removed]', 'deleted', 'removed') THEN 'invalid_text' WHEN u = '' THEN 'missing_user' END AS st FROM rows0 WHERE record_id IS NOT NULL),
s2 AS (SELECT * REPLACE (CASE WHEN st IS NULL AND row_number() OVER (PARTITION BY record_id, st IS NULL ORDER BY created_utc NULLS FIRST, message, thread_id, parent_id, subreddit, source_type) > 1 THEN 'duplicate_record' ELSE st END AS st) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN st IS NULL AND row_number() OVER (PARTITION BY u, message, st IS NULL ORDER BY record_id) > 1 THEN 'duplicate_user_text' ELSE st END AS st) FROM s2)"""
_LAST = "row_number() OVER (PARTITION BY k ORDER BY retrieved_on DESC NULLS LAST, id NULLS FIRST, author NULLS FIRST, created_utc NULLS FIRST, retrieved_on NULLS FIRST, subreddit NULLS FIRST, {0}) AS rn"
_CONTEXT = f"""lc AS (SELECT * FROM (SELECT *, {_LAST.format('body NULLS FIRST, link_id NULLS FIRST, parent_id NULLS FIRST, score NULLS FIRST')} FROM (SELECT *, {_ID.format('id')} AS k FROM comments) WHERE k IS NOT NULL) WHERE rn = 1),
lp AS (SELECT * FROM (SELECT *, {_LAST.format('title NULLS FIRST, selftext NULLS FIRST, score NULLS FIRST, num_comments NULLS FIRST, link_flair_text NULLS FIRST, url NULLS FIRST')} FROM (SELECT *, {_ID.format('id')} AS k FROM posts) WHERE k IS NOT NULL) WHERE rn = 1),
cc AS (SELECT k AS cid, {_ID.format('link_id')} AS thread, CASE WHEN trim(parent_id) LIKE 't1|_%' ESCAPE '|' THEN {_ID.format('parent_id')} END AS parent, {_tidy('body')} AS body FROM lc),
cm AS (SELECT *, lower(body) IN ('', '[deleted]', '[removed]') AS mute FROM cc),
steps AS (
 SELECT cid, parent AS at, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS said FROM cm
 UNION ALL
 SELECT w.cid, p.parent, list_append(w.seen, w.at), CASE WHEN p.mute THEN w.said ELSE list_append(w.said, p.body) END FROM steps w JOIN cm p ON p.cid = w.at WHERE len(w.said) < 4 AND NOT list_contains(w.seen, w.at)),
best AS (SELECT cid, arg_max(said, len(seen)) AS said FROM steps GROUP BY cid),
pt0 AS (SELECT k, concat_ws(chr(10) || chr(10), nullif({_tidy('title')}, ''), nullif({_tidy('selftext')}, '')) AS post FROM lp),
ctx AS (SELECT b.cid, len(said) AS n, right(array_to_string(list_concat(CASE WHEN coalesce(post, '') <> '' THEN ['Original post (context only):' || chr(10) || post] ELSE [] END, list_transform(list_reverse(said), lambda x: 'Earlier reply (context only):' || chr(10) || x)), chr(10) || chr(10)), 8000) AS context FROM best b JOIN cm USING (cid) LEFT JOIN pt0 ON pt0.k = cm.thread)"""
_LABEL = "CASE drug " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE drug END"
_DRUGS = ["brenagliflozin", "pelvagliflozin", "quoragliflozin", "tormagliflozin"]
_PIVOT_N = ", ".join(f"count(*) FILTER (WHERE drug = '{t}') AS n_{t}" for t in _DRUGS)
_PIVOT_P = ", ".join(f"CASE WHEN (SELECT n FROM nsolo WHERE drug = '{t}') > 0 THEN round_even(10000.0 * n_{t} / (SELECT n FROM nsolo WHERE drug = '{t}'), 0) / 100.0 ELSE 0.0 END AS percent_{t}" for t in _DRUGS)
_PIVOT_KEEP = " OR ".join(f"((SELECT n FROM nsolo WHERE drug = '{t}') > 0 AND 100.0 * n_{t} / (SELECT n FROM nsolo WHERE drug = '{t}') >= 0.5)" for t in _DRUGS)

SQL = {
    "recall_exact_by_drug": f"WITH {_POST_COPIES}, {_NAMES}, {_EXACT}, {_first('exact')} SELECT canonical_drug, count(*) AS n_records FROM exact JOIN first USING (doc_id) GROUP BY 1",
    "recall_exact_matches": f"WITH {_POST_COPIES}, {_NAMES}, {_EXACT}, {_first('exact')} SELECT k AS doc_id, canonical_drug, matched_text, lower(matched_text) AS matched_alias FROM exact JOIN first USING (doc_id)",
    "recall_fuzzy_vocabulary": f"WITH {_POST_COPIES}, {_NAMES}, {_FUZZY} SELECT token, canonical_drug, matched_alias, edit_distance, similarity FROM cand",
    "recall_full_policy": f"{_POST_MATCHES}, {_first('per')} SELECT k AS doc_id, m.* EXCLUDE (doc_id) FROM matches m JOIN first USING (doc_id)",
    "recall_comments": f"WITH {_COMMENT_COPIES}, {_MATCHES}, {_first('per')} SELECT canonical_drug, count(*) AS n_records FROM matches JOIN first USING (doc_id) GROUP BY 1",
    "recall_mention_sets": f"{_POST_MATCHES}, {_first('allper')} SELECT mention_set, count(*) AS n_records FROM allper JOIN first USING (doc_id) GROUP BY 1",
    "recall_match_flags": f"{_POST_MATCHES}, {_first('allper')} SELECT count(*) AS n_records, count(*) FILTER (WHERE ex) AS n_exact, count(*) FILTER (WHERE fz) AS n_fuzzy, count(*) FILTER (WHERE fz AND NOT ex) AS n_only_fuzzy, count(*) FILTER (WHERE n = 0) AS n_class_only, count(*) FILTER (WHERE n > 1) AS n_multi_drug FROM allper JOIN first USING (doc_id)",
    "recall_matched_terms": f"{_POST_MATCHES}, {_first('per')} SELECT canonical_drug, matched_text, matched_alias, match_type, edit_distance, similarity, count(*) AS n_records FROM matches JOIN first USING (doc_id) GROUP BY ALL",
    "recall_rate_by_community": f"{_POST_MATCHES}, {_first('per')}, a AS (SELECT subreddit, count(DISTINCT k) AS n_in_scope FROM docs GROUP BY 1), b AS (SELECT subreddit, count(*) AS n FROM first GROUP BY 1) SELECT subreddit, n_in_scope, coalesce(n, 0) AS n_recalled, round_even(1000000.0 * coalesce(n, 0) / n_in_scope, 0) / 10000.0 AS percent_recalled FROM a LEFT JOIN b USING (subreddit)",
    "recall_by_community": f"{_POST_MATCHES}, {_first('per')} SELECT subreddit, count(*) AS n_records, CAST(sum(num_comments) AS BIGINT) AS n_comments FROM first GROUP BY 1",
    "recall_in_period": f"WITH {_POST_COPIES.replace('docs AS MATERIALIZED', 'alldocs AS')}, docs AS MATERIALIZED (SELECT * FROM alldocs WHERE created_utc >= {START} AND created_utc < {END}), {_MATCHES}, {_first('per')} SELECT canonical_drug, count(*) AS n_records FROM matches JOIN first USING (doc_id) GROUP BY 1",
    "scan_stats": f"{_POST_MATCHES} SELECT (SELECT count(*) FROM docs) AS n_rows, (SELECT count(DISTINCT k) FROM docs) AS n_records, (SELECT count(DISTINCT k) FROM docs WHERE doc_id IN (SELECT doc_id FROM allper)) AS n_recalled",
    "recall_top_n": f"{_POST_MATCHES}, {_first('per')} SELECT k AS doc_id, subreddit, created_utc FROM first ORDER BY subreddit, created_utc NULLS FIRST, k LIMIT 50",
    "class_term_posts": f"{_POST_MATCHES} SELECT DISTINCT k AS doc_id FROM klass JOIN docs USING (doc_id)",
    "year_slices_plan": f"SELECT CAST(y AS INTEGER) AS slice_year, greatest({START + 86400 * 40}, CAST(epoch(make_timestamp(y, 1, 1, 0, 0, 0)) AS BIGINT)) AS start_at, least({END + 86400 * 100}, CAST(epoch(make_timestamp(y + 1, 1, 1, 0, 0, 0)) AS BIGINT)) AS end_at FROM range(2023, 2026) t(y)",
    "time_range_scan": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'",
    "normalized_whitespace": "SELECT event_id, trim(regexp_replace('  ' || event_type || ' ' || chr(9) || chr(10) || ' ' || props || ' ', '\\s+', ' ', 'g')) AS text FROM events",
    "record_id_hash": "SELECT event_id, substr(sha256(coalesce(CAST(user_id AS VARCHAR), '') || chr(31) || coalesce(event_type, '') || chr(31) || '' || chr(31) || coalesce(props, '')), 1, 24) AS record_id FROM events",
    "created_iso": f"SELECT DISTINCT {_ID.format('id')} AS post_id, coalesce(strftime(to_timestamp({_SECONDS}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00'), '') AS created FROM posts WHERE {_ID.format('id')} IS NOT NULL",
    "author_hmac": f"SELECT DISTINCT {_ID.format('id')} AS post_id, CASE WHEN a IN ('', '[deleted]', 'deleted') THEN '' ELSE substr({_HMAC.format('a')}, 1, 32) END AS author_hash FROM (SELECT id, lower({_tidy('author')}) AS a FROM posts) WHERE {_ID.format('id')} IS NOT NULL",
    "clean_records": f"WITH {_CLEAN} SELECT record_id, source_type, thread_id, parent_id, subreddit, date, md5(message) AS message_md5 FROM s3 WHERE st IS NULL",
    "clean_audit": f"WITH {_CLEAN} SELECT count(*) AS input_rows, count(*) FILTER (WHERE st = 'invalid_text') AS removed_invalid_or_empty_text, count(*) FILTER (WHERE st = 'missing_user') AS removed_missing_or_deleted_user, count(*) FILTER (WHERE st = 'duplicate_record') AS removed_duplicate_record_id, count(*) FILTER (WHERE st = 'duplicate_user_text') AS removed_duplicate_user_text, count(*) FILTER (WHERE st IS NULL) AS output_rows_before_limit FROM s3",
    "clean_summary": f"WITH {_CLEAN} SELECT source_type, count(*) AS n_rows, count(DISTINCT u) AS n_users FROM s3 WHERE st IS NULL GROUP BY 1",
    "clean_limit": f"WITH {_CLEAN} SELECT record_id, source_type FROM s3 WHERE st IS NULL ORDER BY record_id LIMIT 100",
    "thread_context": f"WITH RECURSIVE {_CONTEXT} SELECT cid AS comment_id, CAST(n AS INTEGER) AS n_ancestors, md5(context) AS context_md5, length(context) AS n_chars FROM ctx",
    "union_posts_comments": f"SELECT source_type, subreddit, count(*) AS n_rows FROM (SELECT 'post' AS source_type, {_COMMUNITY} AS subreddit FROM posts UNION ALL SELECT 'comment', {_COMMUNITY} FROM comments) GROUP BY 1, 2",
    "semi_selected_comments": f"{_POST_MATCHES}, {_COMMENTS_ONCE} SELECT k AS comment_id, {_ID.format('link_id')} AS post_id FROM c WHERE {_ID.format('link_id')} IN (SELECT k FROM docs WHERE doc_id IN (SELECT doc_id FROM per))",
    "targeted_input": f"{_POST_MATCHES}, {_first('per')}, {_COMMENTS_ONCE} SELECT k AS record_id, 'post' AS source_type, k AS thread_id, mention_set AS drugs FROM first JOIN per USING (doc_id) UNION ALL SELECT c.k, 'comment', f.k, mention_set FROM c JOIN (SELECT first.k, mention_set FROM first JOIN per USING (doc_id)) f ON {_ID.format('c.link_id')} = f.k",
    "targeted_input_selected": f"WITH {_COMMENTS_ONCE}, hit AS (SELECT * FROM ({_POST_MATCHES} SELECT DISTINCT k AS post FROM docs WHERE doc_id IN (SELECT doc_id FROM per))), docs AS MATERIALIZED (SELECT k AS doc_id, coalesce(body, '') AS text, {_ID.format('link_id')} AS post FROM c WHERE {_ID.format('link_id')} IN (SELECT post FROM hit)), {_MATCHES} SELECT doc_id AS record_id, post AS thread_id, mention_set AS drugs FROM per JOIN docs USING (doc_id)",
    "anti_missing_records": f"SELECT DISTINCT {_ID.format('record_id')} AS record_id FROM post_extractions WHERE {_ID.format('record_id')} IS NOT NULL AND {_ID.format('record_id')} NOT IN (SELECT {_ID.format('id')} FROM posts WHERE {_ID.format('id')} IS NOT NULL UNION ALL SELECT {_ID.format('id')} FROM comments WHERE {_ID.format('id')} IS NOT NULL)",
    "log_latest": f"{_W} SELECT rid AS record_id, log_line, status, model_name FROM last",
    "log_pending": f"SELECT DISTINCT k AS record_id FROM (SELECT {_ID.format('id')} AS k FROM posts) WHERE k NOT IN (SELECT rid FROM (SELECT {_ID.format('record_id')} AS rid, arg_max(status, log_line) AS s FROM post_extractions WHERE {_ID.format('record_id')} IS NOT NULL GROUP BY 1) WHERE s = 'completed')",
    "regimens_merged": f"{_W} SELECT log_line, exposure_group, n_target_drugs, regimen_pos FROM merged",
    "events_normalized": f"{_W} SELECT log_line, exposure_group, original_expression, meddra_pt, meddra_pt_zh, onset, severity, outcome, confidence FROM nev",
    "flatten_posts": f"{_W} SELECT d.record_id, d.user_id, d.subreddit, d.date_text, count(m.log_line) > 0 AS has_target_exposure, CAST(count(m.log_line) AS INTEGER) AS n_regimens, coalesce(string_agg(m.exposure_group, ' | ' ORDER BY m.regimen_pos), '') AS exposure_groups FROM done d LEFT JOIN merged m USING (log_line) GROUP BY 1, 2, 3, 4",
    "flatten_exposures": f"{_W} SELECT * FROM expo",
    "flatten_events": f"{_W} SELECT record_id, user_id, subreddit, exposure_group, group_type, n_target_drugs, original_expression, proposed_meddra_pt, meddra_pt_zh, onset, severity, outcome, confidence FROM evt",
    "pt_validation": f"{_W} SELECT proposed_meddra_pt, meddra_pt_code, validated_meddra_pt, meddra_validation, count(*) AS n_events FROM evt GROUP BY 1, 2, 3, 4",
    "group_summary": f"{_W} SELECT * FROM summ",
    "term_frequency": f"{_W} SELECT *, round_even(1000.0 * n_users / greatest(n_exposed_users, 1), 0) / 10.0 AS percent_of_exposed_users, round_even(1000.0 * n_users / greatest(n_event_users, 1), 0) / 10.0 AS percent_of_event_reporters FROM freq",
    "top10_terms_per_group": f"{_W} SELECT * FROM (SELECT exposure_group, meddra_pt, n_users, CAST(row_number() OVER (PARTITION BY exposure_group ORDER BY n_users DESC, meddra_pt) AS INTEGER) AS term_rank FROM freq) WHERE term_rank <= 10",
    "symptom_pairs": f"{_W}, n AS (SELECT count(DISTINCT user_id) AS total FROM expo) SELECT a.s AS symptom_1, b.s AS symptom_2, count(*) AS n_users, round_even(1000.0 * count(*) / any_value(total), 0) / 10.0 AS percent_of_exposed FROM sym a JOIN sym b ON a.user_id = b.user_id AND a.s < b.s, n WHERE a.s <> '' GROUP BY 1, 2 HAVING 100.0 * count(*) / any_value(total) >= 0.5",
    "exclusive_users": f"{_W} SELECT drug, n AS n_exclusive_users FROM nsolo",
    "exclusive_term_pivot": f"{_W}, pv AS (SELECT s AS symptom_zh, count(*) AS n_total, {_PIVOT_N} FROM sym JOIN solo USING (user_id) WHERE s <> '' GROUP BY 1) SELECT *, {_PIVOT_P} FROM pv WHERE {_PIVOT_KEEP}",
    "localized_summary": f"{_W} SELECT (SELECT string_agg({_LABEL}, ' + ' ORDER BY i) FROM (SELECT unnest(string_split(exposure_group, ' + ')) AS drug, generate_subscripts(string_split(exposure_group, ' + '), 1) AS i)) AS exposure_group, CASE group_type WHEN 'single' THEN '单药' ELSE '联合用药' END AS group_type, n_target_drugs, n_records, n_exposed_users, n_event_users FROM summ",
    "p2_found": f"WITH {_ANSWERS} SELECT log_line, regimen_pos, 'drug' AS item_kind, drug_pos AS item_pos, -1 AS sub_pos FROM drug UNION ALL SELECT log_line, regimen_pos, 'event', event_pos, -1 FROM ev UNION ALL SELECT log_line, regimen_pos, 'evidence', event_pos, evidence_pos FROM evid",
    "p2_records": f"WITH {_ANSWERS} SELECT log_line, CAST(CASE WHEN json_type(j, '$.regimens') = 'ARRAY' THEN json_array_length(j, '$.regimens') ELSE 0 END AS INTEGER) AS n_regimens FROM obj",
    "p2_regimens": f"WITH {_ANSWERS} SELECT log_line, regimen_pos, CAST(CASE WHEN json_type(r, '$.drugs') = 'ARRAY' THEN json_array_length(r, '$.drugs') ELSE 0 END AS INTEGER) AS n_drugs, CAST(CASE WHEN json_type(r, '$.adverse_events') = 'ARRAY' THEN json_array_length(r, '$.adverse_events') ELSE 0 END AS INTEGER) AS n_events FROM reg",
    "p2_drugs": f"WITH {_ANSWERS} SELECT log_line, regimen_pos, drug_pos, drug FROM drug",
    "p2_adverse_events": f"WITH {_ANSWERS} SELECT log_line, regimen_pos, event_pos, original_expression, {_field('meddra_pt')} AS meddra_pt, {_field('meddra_pt_zh')} AS meddra_pt_zh, {_field('onset')} AS onset, {_field('severity')} AS severity, {_field('outcome')} AS outcome, {_CONF} AS confidence FROM ev",
    "p2_evidence": f"WITH {_ANSWERS} SELECT log_line, regimen_pos, event_pos, evidence_pos, quote, quote_pos FROM evid",
}
