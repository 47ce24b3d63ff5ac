import json

import pytest
from pyspark.sql import functions as F

from vigilmill.operators import context, extractions, localize, recall, records, tables

NAMES = {"dapagliflozin": ["dapagliflozin", "farxiga"], "empagliflozin": ["empagliflozin", "jardiance"]}


def matches(rows, texts):
    df = rows([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    out = {}
    for r in recall.find_matches(df, NAMES).collect():
        out.setdefault(r["doc_id"], []).append((r["canonical_drug"], r["matched_text"], r["match_type"], r["edit_distance"], r["similarity"]))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


def test_recall_policy(rows):
    got = matches(rows, ["Started Farxiga today", "xfarxigax farxiga2", "took farixga", "xigdou", "jardiance", None, "", "empagliflozinn and dapagliflozin", "Farxiga, farixga"])
    d = "dapagliflozin"
    assert got[0] == [(d, "Farxiga", "exact", 0, 1.0)]
    assert got[1] == []
    assert got[2] == [(d, "farixga", "fuzzy", 1, 0.8571)]
    assert got[3] == got[5] == got[6] == []
    assert got[4] == [("empagliflozin", "jardiance", "exact", 0, 1.0)]
    assert got[7] == [(d, d, "exact", 0, 1.0), ("empagliflozin", "empagliflozinn", "fuzzy", 1, 0.9286)]
    assert got[8] == [(d, "Farxiga", "exact", 0, 1.0)]


def test_ambiguous_token(rows):
    # One edit from each of two drugs: no evidence, unless one of them is there exactly.
    names = {"a": ["aaaaaaab"], "b": ["aaaaaaac"]}
    df = rows([(1, "aaaaaaad"), (2, "aaaaaaad aaaaaaab")], "doc_id int, text string")
    got = {(r["doc_id"], r["canonical_drug"], r["match_type"]) for r in recall.find_matches(df, names).collect()}
    assert got == {(2, "a", "exact"), (2, "b", "fuzzy")}


def test_class_terms_and_alias_map(rows):
    df = rows([(1, "any SGLT-2 experience?"), (2, "none")], "doc_id int, text string")
    assert recall.recalled(df, NAMES).count() == 0
    only = recall.recalled(df, NAMES, True).collect()
    assert [(r["doc_id"], r["class_only"], r["matched_target_drugs"]) for r in only] == [(1, True, [])]
    got = recall.alias_map(rows([(" Repa ", ["RepaX", " ", "repax"]), (None, ["x"])], "canonical string, aliases array<string>"))
    assert got == {"repa": ["repax", "repa"]}
    with pytest.raises(ValueError):
        recall.alias_map(rows([(" ", ["x"])], "canonical string, aliases array<string>"))


def test_cleaning(rows):
    data = [
        ("1", "u", "[Removed]", "", 1), ("2", "u", "[removed]", "t", 2), ("3", "[deleted]", "text", "", 3), ("4", "u", "a  b", "", 4),
        ("4", "u", "other", "", 5), ("5", "u", "a b", "", 6), (None, "u", "new", "", 7), ("6", None, "x", "", 8), ("7", "u", None, None, 9),
    ]
    df = rows(data, "id string, user_id string, message string, title string, n int")
    kept = {r["n"]: r for r in records.clean(df.repartition(3), ["n"]).collect()}
    assert set(kept) == {2, 4, 7}
    a = records.audit(df, ["n"]).first()
    assert tuple(a) == (9, 2, 2, 1, 1, 3)
    assert kept[2]["message"] == "t\n\n[removed]" and len(kept[7]["record_id"]) == 24
    assert tuple(records.audit(df.where("false"), ["n"]).first()) == (0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        records.clean(rows([(1,)], "n int"), ["n"])


def test_context(rows):
    post = rows([("p", 1, "Title", "Body"), ("q", 1, None, None)], "id string, retrieved_on bigint, title string, selftext string")
    chain = [(f"m{i}", 1, f"body{i}" if i != 3 else "[deleted]", "t3_p", f"t1_m{i - 1}" if i > 1 else "t3_p") for i in range(1, 8)]
    loop = [("k1", 1, "one", "t3_q", "t1_k2"), ("k2", 1, "two", "t3_q", "t1_k1"), ("x", 1, "lost", "t3_q", "t1_gone"), ("long", 1, "z", "t3_p", "t1_big"), ("big", 1, "y" * 9000, "t3_p", "t3_p")]
    c = rows(chain + loop, "id string, retrieved_on bigint, body string, link_id string, parent_id string")
    got = {r["comment_id"]: r for r in context.comment_context(post, c).collect()}
    said = lambda k: [b.split("\n", 1)[1] for b in got[k]["context"].split("\n\n") if b.startswith("Earlier")]
    assert said("m7") == ["body2", "body4", "body5", "body6"]
    assert said("k1") == ["one", "two"] and said("x") == []
    assert got["m1"]["context"].startswith("Original post (context only):\nTitle\n\nBody")
    assert len(got["long"]["context"]) == 8000 and got["x"]["context"] == ""


LOG = "log_line bigint, record_id string, user_id string, subreddit string, date_text string, status string, extraction string"


def log(rows):
    reg = lambda *r: json.dumps({"regimens": list(r)})
    e = lambda x, pt, zh="", **k: {"original_expression": x, "meddra_pt": pt, "meddra_pt_zh": zh} | k
    return rows(
        [
            (1, "r1", "u1", "s", "d", "failed", None),
            (2, "t1_r1", "u1", "s", "d", "completed", reg({"drugs": ["A"], "adverse_events": [e("sick", "Nausea", "恶心"), e("SICK", "nausea"), e("queasy", "Nausea")]})),
            (3, "r2", "u1", "s", "d", "completed", reg({"drugs": ["a "], "adverse_events": []}, {"drugs": ["A"], "adverse_events": []})),
            (4, "r3", "u2", "s", "d", "completed", reg({"drugs": ["A"], "adverse_events": [e("head", "Headache", "头痛", outcome="RESOLVED ", confidence=5), e("thing", "")]})),
            (5, "r4", "u2", "s", "d", "completed", reg({"drugs": ["B", "a"], "adverse_events": [e("sick", "Nausea", "恶心", outcome="weird", confidence=-1)]})),
            (6, "r5", "u3", "s", "d", "completed", reg({"drugs": ["b"], "adverse_events": {}}, {"drugs": ["zzz"]}, 7)),
            (7, "r6", "u9", "s", "d", "completed", reg({"drugs": ["a"]})),
            (8, "r6", "u9", "s", "d", "failed", None),
            (9, " ", "u9", "s", "d", "completed", reg({"drugs": ["a"]})),
        ],
        LOG,
    )


def test_extraction_to_tables(rows):
    df, targets = log(rows), ["a", "b"]
    terms = rows([(1, "Nausea"), (2, "NAUSEA"), (3, "Headache"), (None, None)], "pt_code bigint, pt_term string")
    study = extractions.Study(df, targets, terms)
    exp, ev = study.exposures(), study.events()
    assert {tuple(r) for r in exp.select("record_id", "user_id", "exposure_group", "has_adverse_events").collect()} == {("r1", "u1", "a", True), ("r2", "u1", "a", False), ("r3", "u2", "a", True), ("r4", "u2", "a + b", True), ("r5", "u3", "b", False)}
    got = {(r["record_id"], r["original_expression"]): r for r in ev.collect()}
    assert set(got) == {("r1", "sick"), ("r1", "queasy"), ("r3", "head"), ("r3", "thing"), ("r4", "sick")}
    assert got["r3", "head"]["outcome"] == "resolved" and got["r3", "head"]["confidence"] == 1.0
    assert got["r4", "sick"]["outcome"] == "unknown" and got["r4", "sick"]["confidence"] == 0.0
    assert got["r1", "sick"]["meddra_pt_code"] == 2 and got["r3", "thing"]["meddra_validation"] == "unmatched"
    summary = {tuple(r) for r in tables.group_summary(exp, ev).select("exposure_group", "n_records", "n_exposed_users", "n_event_users").collect()}
    assert summary == {("a", 3, 2, 2), ("b", 1, 1, 0), ("a + b", 1, 1, 1)}
    freq = {(r["exposure_group"], r["meddra_pt"].lower()): (r["n_users"], r["percent_of_exposed_users"], r["percent_of_event_reporters"], r["meddra_pt_zh"]) for r in tables.term_frequency(exp, ev).collect()}
    assert freq == {("a", "headache"): (1, 50.0, 50.0, "头痛"), ("a", "nausea"): (1, 50.0, 50.0, "恶心"), ("a + b", "nausea"): (1, 100.0, 100.0, "恶心")}
    assert {tuple(r) for r in tables.symptom_pairs(exp, ev).collect()} == {("头痛", "恶心", 1, 33.3)}
    assert {tuple(r) for r in tables.exclusive_users(exp, targets).collect()} == {("u1", "a"), ("u3", "b")}
    pivot = [tuple(r) for r in tables.exclusive_pivot(exp, ev, targets).collect()]
    assert pivot == [("恶心", 1, 1, 100.0, 0, 0.0)]
    posts = {r["record_id"]: (r["has_target_exposure"], r["n_regimens"], r["exposure_groups"]) for r in study.posts().collect()}
    assert posts["r2"] == (True, 1, "a") and "r6" not in posts
    rows_todo = rows([("r1",), ("r6",), ("new",)], "record_id string")
    assert {r[0] for r in extractions.pending(rows_todo, df).collect()} == {"r6", "new"}
    assert extractions.Study(df, targets).events().select("meddra_validation").distinct().collect()[0][0] == "not_checked"
    assert {r[0] for r in extractions.Study(df, targets, terms, rows([("r1",), ("r3",)], "record_id string")).exposures().select("record_id").collect()} == {"r1", "r3"}
    none = extractions.Study(df.where("false"), targets, terms)
    assert tables.term_frequency(none.exposures(), none.events()).count() == 0


def test_localized(rows):
    df = rows([("a + c", "single", "weird"), ("c", "combination", "resolved")], "exposure_group string, group_type string, outcome string")
    got = localize.chinese(df, {"a": "甲"})
    assert got.columns == ["暴露组", "暴露类型", "转归"]
    assert {tuple(r) for r in got.collect()} == {("甲 + c", "单药", "weird"), ("c", "联合用药", "已缓解")}


def test_extractor_lines(rows, spark):
    df = rows([("r1", "u", "s", "d", "took farxiga with nausea", ""), ("r2", "u", "s", "d", "boom", "")], "record_id string, user_id string, subreddit string, date string, message string, context string")
    base = extractions.keyword_extractor(NAMES, ["nausea"])

    def flaky(row):
        if row["message"] == "boom":
            raise RuntimeError("no answer")
        return base(row)

    got = {r["record_id"]: r for r in extractions.extract(df, flaky, list(NAMES), "m", attempts=2).collect()}
    assert got["r1"]["status"] == "completed" and json.loads(got["r1"]["extraction"])["regimens"][0]["drugs"] == ["dapagliflozin"]
    assert got["r2"]["status"] == "failed" and "no answer" in got["r2"]["error_text"]


def test_user_prompt(rows):
    df = rows([("r", "s", "d", "m", " c\n d ")], "record_id string, subreddit string, date string, message string, context string")
    assert df.select(records.user_prompt(F.col("context"))).first()[0] == "record_id: r\nsubreddit: s\ndate: d\n<thread_context>\nc d\n</thread_context>\n<focal_text>\nm\n</focal_text>"


def test_recall_takes_the_first_matching_copy(rows):
    """A record whose first copy has no match is recalled with its second."""
    copies = rows([("1a", "1", 10, "nothing here"), ("1b", "1", 20, "took drugab twice"), ("2a", "2", None, "drugab"), ("2b", "2", 5, "drugab again"), ("3a", "3", 1, None), ("2b", "2", 5, "drugab again")], "doc_id string, id string, retrieved_on long, text string")
    got = {r["id"]: (r["text"], len(r["drug_match_details"]), r["n_copies"]) for r in recall.recalled_once(copies, {"drugab": ["drugab"]}).collect()}
    assert got == {"1": ("took drugab twice", 1, 1), "2": ("drugab again", 1, 3)}
    assert recall.recalled_once(copies.where("false"), {"drugab": ["drugab"]}).count() == 0
    s = recall.scan_stats(copies, recall.recalled_once(copies, {"drugab": ["drugab"]})).first().asDict()
    assert s == {"n_rows": 6, "n_records": 3, "n_recalled": 2}


def test_last_line_of_a_term_wins(spark, tmp_path):
    """Also if its code is the smaller one."""
    from vigilmill.sources import readers

    (tmp_path / "pt.asc").write_text("200$Dry mouth$x\n100$DRY MOUTH$y\n300$Rash\n", encoding="latin-1")
    got = {r["pt_key"]: (r["pt_code"], r["pt_term"]) for r in extractions.terms(readers.term_dictionary(spark, str(tmp_path / "pt.asc"))).collect()}
    assert got == {"dry mouth": (100, "DRY MOUTH"), "rash": (300, "Rash")}


def test_targeted_rows(rows):
    from vigilmill.operators.targeted import targeted_rows

    posts = rows([("p", "ann", 5, 1, "S", "t", "x"), ("q", "bo", 5, 1, "S", "t", "y")], "id string, author string, created_utc long, retrieved_on long, subreddit string, title string, selftext string")
    comments = rows([("c", "ann", 6, 2, "S", "b", "t3_p", "t3_p"), ("e", "bo", 6, 2, "S", "b", "p", "t1_c"), ("f", "bo", 6, 2, "S", "b", "q", "t3_q")], "id string, author string, created_utc long, retrieved_on long, subreddit string, body string, link_id string, parent_id string")
    rec = rows([("p", ["d"])], "id string, matched_target_drugs array<string>")
    own = rows([("e", ["z"])], "id string, matched_target_drugs array<string>")
    got = {(r["record_id"], tuple(r["recalled_target_drugs"])) for r in targeted_rows(posts, comments, rec, b"s").collect()}
    assert got == {("p", ("d",)), ("c", ("d",)), ("e", ("d",))}
    got = {(r["record_id"], tuple(r["recalled_target_drugs"])) for r in targeted_rows(posts, comments, rec, b"s", own).collect()}
    assert got == {("p", ("d",)), ("e", ("z",))}
    for bad, more in ((rows([("gone", ["d"])], "id string, matched_target_drugs array<string>"), None), (rec.unionByName(rec), None), (rec, rows([("f", ["d"])], "id string, matched_target_drugs array<string>"))):
        with pytest.raises(Exception, match="recall"):
            targeted_rows(posts, comments, bad, b"s", more).collect()
    assert targeted_rows(posts, comments, rec.where("false"), b"s").count() == 0
