import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigilmill.operators.dedup import keep_one_delivery

SCHEMA = "id string, retrieved_on bigint, body string"


def test_first_last_and_ties(rows):
    df = rows([("t1_a", 5, "x"), ("a", 3, "y"), (" a ", 3, None), ("a", None, "z"), ("b", None, "q"), ("", 1, "n"), (None, 1, "n"), (None, 1, "n")], SCHEMA)
    first = {r["id"]: (r["retrieved_on"], r["body"], r["n_copies"]) for r in keep_one_delivery(df).collect()}
    assert first == {"a": (3, None, 4), "b": (None, "q", 1)}
    last = {r["id"]: r["body"] for r in keep_one_delivery(df, keep="last").collect()}
    assert last == {"a": "x", "b": "q"}
    assert keep_one_delivery(df, keep_null_ids=True).count() == 5
    clash = keep_one_delivery(df.withColumnRenamed("body", "n_copies"))
    assert clash.columns == ["id", "retrieved_on", "n_copies", "n_copies_"] and clash.count() == 2
    with pytest.raises(ValueError):
        keep_one_delivery(df, keep="middle")
    assert keep_one_delivery(df.where("false")).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("xy"))), max_size=12), st.integers(1, 5))
def test_partitioning_does_not_matter(spark, data, n):
    df = spark.createDataFrame(data, SCHEMA)
    a, b = (sorted(map(repr, keep_one_delivery(x).collect())) for x in (df.coalesce(1), df.repartition(n)))
    assert a == b
    assert len(a) == len({i for i, _, _ in data if i})


def test_both_ways_of_joining_agree(rows):
    df = rows([("a", 5, "x"), ("a", 3, "y"), ("b", None, "q"), ("c", 1, "n"), ("c", 1, "n"), ("c", 1, "m"), (None, 1, "n")], SCHEMA)
    a, b = (sorted(map(tuple, keep_one_delivery(df, broadcast_ids=n).collect())) for n in (0, 100))
    assert a == b == [("a", 3, "y", 2), ("b", None, "q", 1), ("c", 1, "m", 3)]


def test_no_sort_aggregation_of_single_copies(rows):
    """The choice of ids with several copies hashes; only tied rows are sorted."""
    df = rows([("a", 5, "x"), ("b", 3, "y"), ("b", 3, "z")], SCHEMA)
    plan = keep_one_delivery(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "LeftAnti" in plan
