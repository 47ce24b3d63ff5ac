import random

import numpy as np

from vigilmill.llm import near_duplicates as nd

TEXTS = "space string, id string, text string, extra int"


def corpus(seed=1, groups=25, words=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    out = []
    for g in range(groups):
        base = r.sample(vocab, r.randint(45, 45 + words))
        for k in range(r.randint(1, 4)):
            own = base[:]
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocab)
            r.shuffle(own)
            out.append(("s", f"g{g:02d}_{k}", " ".join(own), 1))
    out += [("s", f"short{k}", " ".join(r.sample(vocab, 39)), 1) for k in range(4)]
    return out


def brute(data, t=0.75):
    sets = [(s, i, frozenset(nd.word_list(x))) for s, i, x, _ in data if i and x and len(nd.word_list(x)) >= 40]
    return {(s, min(i, j), max(i, j)) for k, (s, i, a) in enumerate(sets) for u, j, b in sets[k + 1 :] if s == u and i != j and len(a & b) / len(a | b) >= t}


def test_against_all_pairs(rows):
    data = corpus()
    data += [("other", *x[1:]) for x in data[:5]] + [data[0], ("s", None, data[0][2], 1), ("s", "null", None, 1), ("s", "upper", data[0][2].upper(), 1), ("s", "look", data[0][2].replace("w", "ｗ"), 1)]
    got = {tuple(r) for r in nd.NearDuplicates(rows(data, TEXTS)).pairs().collect()}
    assert got == brute(data)


def test_large_keys_go_through_leaves(rows, monkeypatch):
    """All texts alike, leaves of four: pairs come from boxes across leaves."""
    monkeypatch.setattr(nd, "LEAF", 4)
    r = random.Random(3)
    base = [f"v{k}" for k in range(80)]
    data = [("s", f"d{k:02d}", " ".join(base[:-2] + [f"x{r.randrange(99)}", f"y{r.randrange(99)}"]), 1) for k in range(30)]
    got = {tuple(x) for x in nd.NearDuplicates(rows(data, TEXTS)).pairs().collect()}
    assert got == brute(data)


def test_many_copies_are_a_star(rows):
    data = [("s", f"c{k:02d}", corpus()[0][2], 1) for k in range(12)]
    d = nd.NearDuplicates(rows(data, TEXTS))
    assert {tuple(r) for r in d.pairs(all_pairs=5).collect()} == {("s", "c00", f"c{k:02d}") for k in range(1, 12)}
    assert {tuple(r)[2:] for r in d.link_counts().collect()} == {(12, 0)}
    assert nd.NearDuplicates(rows([], TEXTS)).pairs().count() == 0


def test_hot_classes_give_every_pair(rows, monkeypatch):
    """Two linked classes of more than 200 ids, in several blocks each."""
    monkeypatch.setattr(nd, "BLOCK", 90)
    base = [f"w{k}" for k in range(60)]
    first, other = " ".join(base), " ".join(base[:-1] + ["edited"])
    turned = " ".join(base[::-1]).upper() + "."
    data = [("s", f"a{k:03d}", first if k % 2 else turned, 1) for k in range(210)] + [("s", f"b{k:03d}", other, 1) for k in range(205)]
    data += [("s", "a000", other, 1), ("s", "lone", " ".join(base[2:]), 1)]
    got = [tuple(r) for r in nd.NearDuplicates(rows(data, TEXTS)).pairs().collect()]
    ids = sorted({i for _, i, _, _ in data})
    assert len(got) == len(set(got)) and set(got) == {("s", i, j) for k, i in enumerate(ids) for j in ids[k + 1 :]}


def test_class_queries_give_the_pairs(spark, rows, tmp_path):
    from vigilmill.llm import queries

    base = [f"w{k}" for k in range(60)]
    text = {"a": " ".join(base), "b": " ".join(base[::-1]).upper(), "c": " ".join(base[:-1] + ["edited"])}
    rows(list(text.items()), "id string, selftext string").write.parquet(f"{tmp_path}/posts.parquet")
    rows([], "id string, body string").write.parquet(f"{tmp_path}/comments.parquet")
    key = {r["id"]: r["class_key"] for r in queries.QUERIES["p6_classes"](spark, str(tmp_path)).collect()}
    assert key["a"] == key["b"] != key["c"]
    (link,) = queries.QUERIES["p6_class_links"](spark, str(tmp_path)).collect()
    assert link["table_name"] == "posts" and (link["class_a"], link["class_b"]) == tuple(sorted([key["a"], key["c"]]))


def test_bound_never_loses():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**32, r.integers(40, 90), np.uint32))
        b = np.unique(np.concatenate([a[: len(a) - r.integers(0, 12)], r.integers(0, 2**32, r.integers(0, 9), np.uint32)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        v = nd.unpack_counts(nd.pack_counts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        if j >= 0.75:
            assert nd.may_reach(v[:1], v[1:], 0.75)[0]
            lo, hi = (x.astype(np.uint8).tobytes() for x in (v[0], v[0]))
            assert nd.boxes_may_meet(lo, hi, v[1].astype(np.uint8).tobytes(), v[1].astype(np.uint8).tobytes(), 0.75)


def test_groups_are_components(rows):
    """Chains of links, copies and texts without links."""
    base = [f"w{i}" for i in range(60)]
    texts = [(str(k), " ".join(base[5 * k : 5 * k + 50] if k < 3 else [f"v{k}{i}" for i in range(45)])) for k in range(5)]
    texts += [("copy", texts[1][1])]
    df = rows([("posts", i, t) for i, t in texts] + [("comments", "0", texts[0][1])], "space string, id string, text string")
    near = nd.NearDuplicates(df)
    got = {(r["space"], r["id"]): r["group_key"] for r in near.groups().collect()}
    assert len({got["posts", i] for i in ("0", "1", "2", "copy")}) == 1
    assert len(set(got.values())) == 4 and len(got) == 7
    assert near.links().count() == 2
    assert nd.NearDuplicates(df.where("false")).groups().count() == 0
