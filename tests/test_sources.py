import json
import os

import pytest

from vigilmill.operators import recall
from vigilmill.sources import forum_api, readers, sinks, slices
from vigilmill.streaming import extraction_log, ingest


class FakeForum:
    """A transport over a file of records, at most ``limit`` a page."""

    def __init__(self, options):
        with open(options["records"], encoding="utf-8") as f:
            self.all = json.load(f)

    def get(self, endpoint, params):
        kind = endpoint.split("/")[0]
        hits = [r for r in self.all if r["kind"] == kind and r["subreddit"] == params["subreddit"] and params["after"] <= r["created_utc"] < params["before"]]
        return sorted(hits, key=lambda r: (r["created_utc"], r["id"]))[: params["limit"]]


def test_pages_loses_no_boundary_second():
    data = [{"id": f"i{k}", "created_utc": 100 + k // 3} for k in range(40)]
    fetch = lambda a, b: sorted([r for r in data if a <= r["created_utc"] < b], key=lambda r: r["created_utc"])[:7]
    got = [r["id"] for r in forum_api.pages(fetch, 100, 1000, 7)]
    assert sorted(got) == sorted(r["id"] for r in data)
    assert len(list(forum_api.pages(lambda a, b: [], 1, 9, 7))) == 0
    with pytest.raises(ValueError):
        list(forum_api.pages(lambda a, b: [{"id": "x", "created_utc": "soon"}], 1, 9, 7))


def test_a_second_that_fills_pages():
    """The other end of a full second comes from a descending query; if both ends don't meet, the read fails."""
    def api(n):
        all_ = [{"id": f"x{k:02d}", "created_utc": 500} for k in range(n)] + [{"id": "z", "created_utc": 900}]
        asc = lambda a, b: [r for r in all_ if a <= r["created_utc"] < b][:7]
        desc = lambda a, b: [r for r in all_ if a <= r["created_utc"] < b][::-1][:7]
        return all_, asc, desc

    all_, asc, desc = api(12)
    assert sorted(r["id"] for r in forum_api.pages(asc, 500, 1000, 7, fetch_newest=desc)) == sorted(r["id"] for r in all_)
    all_, asc, desc = api(20)
    with pytest.raises(ValueError, match="more records"):
        list(forum_api.pages(asc, 500, 1000, 7, fetch_newest=desc))
    with pytest.raises(ValueError, match="more records"):
        list(forum_api.pages(asc, 500, 1000, 7))


def test_items_and_waits():
    assert forum_api.items_of({"data": [{"a": 1}, 3]}) == [{"a": 1}] == forum_api.items_of([{"a": 1}, None])
    for bad in (3, {"data": 5}):
        with pytest.raises(TypeError):
            forum_api.items_of(bad)
    flat = lambda: 0.0
    assert forum_api.wait_seconds({"X-RateLimit-Reset": "0.2"}, 1) == 1.0
    assert forum_api.wait_seconds({"Retry-After": "7"}, 1) == 7.0
    assert forum_api.wait_seconds({"Retry-After": "Thu, 01 Jan 1970 00:01:40 GMT"}, 1, now=40.0) == 60.0
    assert [forum_api.wait_seconds({}, k, jitter=flat) for k in (1, 6, 9)] == [2.0, 60.0, 60.0]


def test_http_retries(monkeypatch):
    t = forum_api.HttpTransport({"url": "http://x/", "maxRetries": "3"})
    waits, answers = [], iter([TimeoutError(), "no json", '{"data": [{"id": "a"}]}'])

    def opened(url):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    monkeypatch.setattr(t, "open", opened)
    t.sleep = waits.append
    assert t.get("posts/search", {"a": 1}) == [{"id": "a"}] and len(waits) == 2


def test_data_source(spark, tmp_path):
    records = [{"kind": "posts", "id": f"p{k}", "subreddit": s, "created_utc": 1703980800 + 6 * 3600 * k, "title": "t", "score": "3", "num_comments": None} for s in ("a", "b") for k in range(9)]
    (tmp_path / "r.json").write_text(json.dumps(records))
    spark.dataSource.register(forum_api.ForumApi)
    df = spark.read.format("forum_api").options(communities="a, r/A,b", kind="posts", start=1703980800, end=1704153600, pageSize=2, delay=0, transport="tests.test_sources:FakeForum", records=str(tmp_path / "r.json")).load()
    assert df.rdd.getNumPartitions() == 4  # two communities, two years
    got = df.select("id", "subreddit", "score").collect()
    assert sorted((r["subreddit"], r["id"], r["score"]) for r in got) == sorted((s, f"p{k}", 3) for s in "ab" for k in range(8))


def test_slices(spark):
    assert slices.slice_bounds(1703980800, 1704153600) == [(1703980800, 1704067200), (1704067200, 1704153600)]
    assert slices.slice_bounds(5, 5) == []
    assert [(r[1], r[2]) for r in slices.year_slices(spark, 1703980800, 1704153600).collect()] == slices.slice_bounds(1703980800, 1704153600)
    plan = slices.plan_jobs(spark, ["A", "r/a", " b "], ["posts", "comments"], 1703980800, 1704153600).collect()
    assert [r["job_no"] for r in plan] == list(range(1, 9)) and {r["community"] for r in plan} == {"A", "b"}


def test_json_lines(spark, tmp_path):
    for d in ("Posts", "comments"):
        os.makedirs(tmp_path / "x" / d)
    (tmp_path / "x/Posts/a.jsonl").write_text('{"id": "1"}\n\n{"id": "2", "more": 1}\n')
    (tmp_path / "x/comments/b.jsonl").write_text('{"id": "3"}\n[1]\nnope\n')
    assert [r["id"] for r in readers.json_lines(spark, str(tmp_path / "x"), "id string", parent="posts").orderBy("_file", "_pos").collect()] == ["1", "2"]
    assert readers.json_lines(spark, str(tmp_path / "x"), "id string", strict=False).count() == 3
    assert readers.count_whole_lines(spark, str(tmp_path / "x")) == 3
    with pytest.raises(Exception, match="no JSON object"):
        readers.json_lines(spark, str(tmp_path / "x/comments"), "id string").collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('user_id,message\nu,"x ""y""\nz"\nv,\n')
    assert [tuple(r) for r in readers.input_table(spark, str(tmp_path / "a.csv")).collect()] == [("u", 'x "y"\nz'), ("v", "")]
    with pytest.raises(ValueError):
        readers.input_table(spark, "a.xml")
    (tmp_path / "pt.asc").write_bytes("1$Nausea$x\n2$Œd".encode("latin-1", "replace") + "è$y\n".encode("latin-1"))
    assert [r["pt_code"] for r in readers.term_dictionary(spark, str(tmp_path / "pt.asc")).collect()] == [1, 2]
    (tmp_path / "al.json").write_text('{"A": ["x", " "], " ": ["y"]}')
    assert [tuple(r) for r in readers.alias_table(spark, str(tmp_path / "al.json")).collect()] == [("a", ["x"])]
    for bad in ("{}", "[]", '{"a": 3}', '{"a": [" "]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.alias_table(spark, str(tmp_path / "bad.json"))
    (tmp_path / "l.json").write_text('{"A": "甲"}')
    assert readers.drug_labels(str(tmp_path / "l.json"), ["a", "b", "c"], {"b": "乙"}) == {"a": "甲", "b": "乙", "c": "c"}
    with pytest.raises(ValueError):
        readers.checked_result(spark, str(tmp_path / "a.csv"), {"exposure_group"})


def test_log_with_torn_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"record_id": "a", "status": "failed"}\n{"record_id": "a", "status": "completed"}\n{"record_id": "b", "sta')
    got = readers.extraction_log(spark, str(tmp_path)).orderBy("log_line").collect()
    assert [(r["log_line"], r["status"]) for r in got] == [(1, "failed"), (2, "completed")]


def test_recall_sink(spark, rows, tmp_path):
    df = rows([(1, "on farxiga"), (2, "none")], "doc_id int, text string")
    p = {"names": {"d": ["farxiga"]}}
    path = str(tmp_path / "out")
    assert sinks.saved_recall(spark, path, p) is None
    summary = sinks.write_recall(recall.recalled(df, p["names"]), path, p)
    assert summary["n_records"] == 1 and summary["by_drug"] == {"d": 1}
    assert sinks.saved_recall(spark, path, p).count() == 1
    assert sinks.saved_recall(spark, path, {"names": {}}) is None
    os.remove(f"{path}/summary.json")
    with pytest.raises(ValueError):
        sinks.saved_recall(spark, path, p)
    with sinks.folder_lock(path), pytest.raises(RuntimeError):
        with sinks.folder_lock(path):
            pass


def test_fingerprint_ignores_order(rows):
    df = rows([(1, "a"), (2, None)], "n int, s string")
    assert sinks.content_fingerprint(df, ["n", "s"]) == sinks.content_fingerprint(df.orderBy("n", ascending=False).repartition(3), ["n", "s"])


def test_incremental_ingest(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    os.makedirs(src)
    schema = "id string, retrieved_on bigint, subreddit string, body string"
    line = lambda i, t: json.dumps({"id": i, "retrieved_on": t, "subreddit": "s", "body": "b"}) + "\n"
    (tmp_path / "src/1.jsonl").write_text(line("a", 1700000000) + line("t1_a", 1700000000) + line("b", 1700000100))
    ingest.ingest(spark, src, schema, out, cp).awaitTermination()
    (tmp_path / "src/2.jsonl").write_text(line("b", 1700000200) + line("c", 1700000300))
    ingest.ingest(spark, src, schema, out, cp).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_ingest_takes_old_records_and_late_copies(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    os.makedirs(src)
    schema = "id string, retrieved_on bigint, subreddit string, body string"
    line = lambda i, t: json.dumps({"id": i, "retrieved_on": t, "subreddit": "s", "body": "b"}) + "\n"
    for k, text in enumerate((line("a", 1700000000), line("b", 1710000000), line("old", 1600000000) + line("t1_a", 1720000000) + line("none", None))):
        (tmp_path / f"src/{k}.jsonl").write_text(text)
        ingest.ingest(spark, src, schema, out, cp).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "none", "old"]


def test_resume(spark, rows, tmp_path):
    df = rows([("r1", "u", "s", "d", "m", ""), ("r2", "u", "s", "d", "bad", "")], "record_id string, user_id string, subreddit string, date string, message string, context string")
    path = str(tmp_path / "log")

    def half(row):
        if row["message"] == "bad":
            raise ValueError("no")
        return "{}"

    assert extraction_log.run_pending(df, path, half, ["a"], "m") == 2
    assert extraction_log.run_pending(df, path, lambda row: "{}", ["a"], "m") == 1  # only the failed one
    assert extraction_log.run_pending(df, path, half, ["a"], "m") == 0


STORE = {"a": [(i, 100 + i) for i in range(25)], "b": [(i + 100, 500) for i in range(3)]}


class FakeTransport:
    """A forum with two threads; thread x always fails. FAIL stops it after some calls."""

    def __init__(self, options):
        self.options = options

    def get(self, endpoint, p):
        q = p["link_id"]
        if q == "x" or os.path.exists(self.options.get("down", "/none") + q):
            raise RuntimeError("down")
        rows = [{"id": f"c{i}", "created_utc": t, "link_id": q, "body": "b"} for i, t in STORE[q] if p["after"] <= t < p["before"]]
        rows.sort(key=lambda r: r["created_utc"], reverse=p["sort"] == "desc")
        return rows[: p["limit"]] + ([{"created_utc": 100, "body": "no id"}] if q == "a" else [])


def test_thread_jobs_resume(spark, rows, tmp_path):
    """A failed thread doesn't stop the others; a second run takes up only what is pending, without loss or repeat."""
    from vigilmill.sources import jobs

    path, down = str(tmp_path / "threads"), str(tmp_path / "down-")
    open(down + "b", "w").close()
    opt = {"transport": "tests.test_sources:FakeTransport", "pageSize": "7", "delay": "0", "down": down}
    posts = rows([("a", 90.0), ("b", None), ("x", 1.0), ("a", 95.0), (None, 1.0)], "post_id string, created_utc double")
    todo = jobs.thread_jobs(posts, 50, 1000)
    assert {r["job_id"] for r in jobs.ingest_jobs(spark, todo, path, opt, "comments").collect()} == {"thread/b", "thread/x"}
    assert jobs.ingested(spark, path, "comments").count() == 25
    # A part without its note is what a crash leaves behind.
    spark.createDataFrame([("thread/b", "lost")], "job_id string, id string").write.parquet(f"{path}/data/part=1")
    os.remove(down + "b")
    assert {r["job_id"] for r in jobs.ingest_jobs(spark, todo, path, opt, "comments").collect()} == {"thread/x"}
    assert sorted(r["id"] for r in jobs.ingested(spark, path, "comments").collect()) == sorted(f"c{i}" for v in STORE.values() for i, _ in v)
    jobs.ingest_jobs(spark, jobs.thread_jobs(posts, 50, 2000), path, opt, "comments")
    assert jobs.ingested(spark, path, "comments").count() == 28
    with pytest.raises(ValueError, match="other settings"):
        jobs.ingest_jobs(spark, todo, path, opt, "posts")


def test_log_refuses_other_settings(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    r = rows([("1", "u", "s", "d", "text", "")], "record_id string, user_id string, subreddit string, date string, message string, context string")
    assert extraction_log.run_pending(r, path, lambda row: "{}", ["d"], "m", at_once=2) == 1
    assert extraction_log.run_pending(r, path, lambda row: "{}", ["d"], "m") == 0
    with pytest.raises(ValueError, match="model_name"):
        extraction_log.run_pending(r, path, lambda row: "{}", ["d"], "other")
    assert extraction_log.run_pending(r, path, lambda row: row["prompt"], ["e"], "m", restart=True) == 1
