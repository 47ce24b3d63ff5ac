import json

import pyarrow as pa

from vigilmill.operators import flatten as f

SCHEMA = "log_line bigint, extraction string, extra string"
ANSWER = {"regimens": [None, {"drugs": ["a", " ", 5, "a"], "adverse_events": [{"original_expression": "x", "confidence": "0.5", "evidence": [{"quote": "q", "pos": 1}, {"pos": 2}, {"quote": 3}, {"quote": "r"}]}, {"original_expression": ""}, 7, {"original_expression": "y", "evidence": {}}]}, {"drugs": "a"}, {}]}
WANT = {(1, "drug", 0, -1), (1, "drug", 3, -1), (1, "event", 0, -1), (1, "event", 3, -1), (1, "evidence", 0, 0), (1, "evidence", 0, 3)}


def items(rows, text):
    return {tuple(r)[1:] for r in f.flat_answers(rows([(1, text, "e")], SCHEMA), "item").collect()}


def test_wrappings(rows):
    plain = json.dumps(ANSWER)
    for text in (plain, f"```json\n{plain}\n```", json.dumps(plain), json.dumps(f"```\n{plain}\n```"), f"  {json.dumps(ANSWER, indent=1)}\n"):
        assert items(rows, text) == WANT


def test_not_whole(rows):
    plain = json.dumps(ANSWER)
    for text in (None, "", "  ", plain[:-3], "[]", "null", "not available", '"text"', "[" * 5000, '{"regimens": {}}', '{"a": 1}', "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")):
        assert items(rows, text) == set()


def test_links_and_values(rows):
    df = rows([(7, json.dumps(ANSWER), "e"), (8, None, "e"), (9, json.dumps({"regimens": []}), "e")], SCHEMA)
    t = {k: f.flat_answers(df, k).collect() for k in ("record", "regimen", "drug", "event", "evidence")}
    assert [tuple(r) for r in t["record"]] == [(7, 4), (9, 0)]
    assert [tuple(r) for r in t["regimen"]] == [(7, 1, 4, 4), (7, 2, 0, 0), (7, 3, 0, 0)]
    assert t["event"][0]["confidence"] == 0.5 and t["event"][0]["meddra_pt"] is None
    parents = {(r["log_line"], r["regimen_pos"]) for r in t["regimen"]}
    events = {(r["log_line"], r["regimen_pos"], r["event_pos"]) for r in t["event"]}
    assert {(r["log_line"], r["regimen_pos"]) for r in t["event"] + t["drug"]} <= parents
    assert {(r["log_line"], r["regimen_pos"], r["event_pos"]) for r in t["evidence"]} <= events
    assert f.flat_answers(rows([], SCHEMA), "item").count() == 0


def test_kernel_on_slices_and_nulls():
    lists = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int64()))
    for a, keys in ((lists, pa.array([10, 11, 12, 13])), (lists.slice(1), pa.array([11, 12, 13]))):
        child, k = f.flatten_list(a, {"key": keys}, "pos")
        want = [(v, key, i) for key, vs in zip(keys.to_pylist(), a.to_pylist()) for i, v in enumerate(vs or [])]
        assert list(zip(child.to_pylist(), k["key"].to_pylist(), k["pos"].to_pylist())) == want
