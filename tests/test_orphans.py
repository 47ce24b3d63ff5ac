import pytest

from vigilmill.operators import orphans

POST = "id string, retrieved_on bigint, selftext string, extra string"
COMMENT = "id string, retrieved_on bigint, body string, link_id string, parent_id string, extra string"


def test_match_semantics(rows):
    refs = rows([(1, "a", "x"), (2, "a", None), (3, "b", None), (4, None, None), (5, "z", "x")], "n int, k1 string, k2 string")
    targets = rows([("a", "x"), ("a", "y"), (None, "q")], "k1 string, k2 string")
    bad = lambda m: {r["n"] for r in orphans.orphan_references(refs, targets, ["k1", "k2"], m).collect()}
    assert bad("simple") == {5}
    assert bad("full") == {2, 3, 5}
    assert bad("partial") == {3, 5}
    with pytest.raises(ValueError):
        orphans.orphan_references(refs, targets, ["k1", "k2"], "none")


def test_payload_does_not_multiply_rows(rows):
    refs = rows([(1, "a", None), (1, "a", None)], "n int, k1 string, k2 string")
    targets = rows([("a", "x", 5), ("a", "y", 3)], "k1 string, k2 string, v int")
    got = orphans.resolve_references(refs, targets, ["k1", "k2"], ["v"]).collect()
    assert [(r["ref_status"], r["v"]) for r in got] == [("found", 3)] * 2
    clash = orphans.resolve_references(refs.withColumnRenamed("n", "v"), targets, ["k1", "k2"], ["v"])
    assert clash.columns == ["v", "k1", "k2", "ref_status", "v_"] and [tuple(r)[-1] for r in clash.collect()] == [3, 3]


def test_forum_kinds(rows):
    posts = rows([("t3_p1", 10, "hello", "e"), ("p2", 5, "text", "e"), ("p2", 9, "[Removed]", "e"), (" p3 ", 50, "late", "e"), (None, 1, "x", "e"), ("p4", None, "[deleted]", "e")], POST)
    comments = rows(
        [
            ("c1", 20, "a", "t3_p1", "t3_p1", "e"),  # fine
            ("t1_c2", 20, "a", "p2", "t1_c1", "e"),  # newest copy of the post is removed
            ("c3", 20, "a", "p3", "t1_gone", "e"),  # late post, missing parent
            ("c4", None, "a", "p3", "  ", "e"),  # unknown time: never late
            ("c5", 20, "a", "nope", "t1_c9", "e"),
            ("c5", 30, "a", "nope", "t1_c9", "e"),  # repeated: one row each
            ("c9", 25, "[deleted]", "", None, "e"),
            ("  ", 25, "b", "nope", "t1_nope", "e"),  # blank id: ignored
            ("c6", 20, "a", "p4", "t3_p1", "e"),
        ],
        COMMENT,
    )
    got = {tuple(r) for r in orphans.orphans_per_comment(orphans.forum_orphans(posts, comments)).collect()}
    assert got == {("c2", "link_id", "deleted"), ("c3", "link_id", "late"), ("c3", "parent_id", "missing"), ("c5", "link_id", "missing"), ("c5", "parent_id", "deleted"), ("c6", "link_id", "deleted")}


def test_by_month_and_empty(rows):
    comments = rows([("c1", 1700000000, "a", "p1", None, "e"), ("c2", None, "a", "p1", None, "e")], COMMENT)
    none = rows([], POST)
    got = {(r["target_table"], r["month"], r["kind"], r["n_references"], r["n_targets"]) for r in orphans.orphans_by_month(orphans.forum_orphans(none, comments)).collect()}
    assert got == {("posts", "2023-11", "missing", 1, 1), ("posts", "unknown", "missing", 1, 1)}
    assert orphans.forum_orphans(none, rows([], COMMENT)).count() == 0


def test_undeclared_mask_fails(rows):
    """A reference whose null mask was not declared stops the job instead of vanishing."""
    import pytest

    refs = rows([(1, "a", "b"), (2, "a", None), (3, None, "b")], "n int, x string, y string")
    targets = rows([("a", "b")], "x string, y string")
    assert orphans.resolve_references(refs, targets, ["x", "y"]).count() == 3
    with pytest.raises(Exception, match="undeclared null mask"):
        orphans.resolve_references(refs, targets, ["x", "y"], masks=[0b10]).collect()
