import random

import numpy as np
import pytest

from vigilmill.operators import hierarchy as h

POST = "id string"
COMMENT = "id string, retrieved_on bigint, link_id string, parent_id string"


def brute(parent, posts):
    out = {}
    for c in parent:
        at, path = "t1_" + c, []
        while True:
            if at in path:
                out[c] = ("cycle", -1, None)
                break
            path.append(at)
            up = parent.get(at[3:]) if at.startswith("t1_") else None
            if up is None or not (up[3:] in posts if up.startswith("t3_") else up[3:] in parent):
                out[c] = (at, len(path) - 1, path[::-1])
                break
            at = up
    return out


@pytest.mark.parametrize("local_edges", [0, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_walk(spark, seed, local_edges):
    r = random.Random(seed)
    ids = [f"c{i}" for i in range(60)]
    parent = {c: r.choice([None, "t3_p", "t3_gone", "t1_gone", *("t1_" + r.choice(ids) for _ in range(6))]) for c in ids}
    chain = [f"d{i}" for i in range(25)]
    parent |= {c: ("t1_" + chain[i - 1] if i else "t3_p") for i, c in enumerate(chain)}
    parent |= {f"s{i}": "t1_d3" for i in range(30)} | {"me": "t1_me"}
    want = brute(parent, {"p"})
    comments = spark.createDataFrame([(c, 1, None, p) for c, p in parent.items()], COMMENT)
    got = h.comment_hierarchy(spark.createDataFrame([("p",)], POST), comments, True, local_edges).collect()
    assert {r["node"][3:]: (r["root"], r["depth"], r["path"]) for r in got} == want
    lazy = spark.createDataFrame([(x["node"], x["path"]) for x in got], "node string, path array<string>")
    pairs = {tuple(x) for x in h.descendants(lazy).collect()}
    assert pairs == {(a, "t1_" + c, len(p) - 1 - i) for c, (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}


def test_links_copies_and_blanks(rows):
    posts = rows([("t3_p",), (None,)], POST)
    comments = rows([("a", 1, "p", ""), ("b", 1, "p", " t1_a "), ("b", 9, "p", "t1_gone"), (" ", 1, "p", "t1_a"), (None, 1, "p", "t1_a"), ("c", 1, None, None), ("d", 1, "gone", None)], COMMENT)
    got = {r["node"]: (r["root"], r["depth"]) for r in h.comment_hierarchy(posts, comments).collect()}
    assert got == {"t1_a": ("t3_p", 1), "t1_b": ("t1_b", 0), "t1_c": ("t1_c", 0), "t1_d": ("t1_d", 0)}
    assert h.comment_hierarchy(posts, comments.where("false")).count() == 0


def test_long_chain_needs_few_rounds():
    n = 5000
    node, parent = np.arange(1, n), np.arange(n - 1)
    steps, loops = h.contract_arrays(node, parent, n)
    assert not loops.size and len(steps) < 120
    assert sum(len(s[0]) for s in steps) == n - 1
