import random

from vigilmill.llm import leakage as k

DOC = "doc_id bigint, text string, extra int"
ITEM = "item_id bigint, lang string, text string, extra int"


def test_words_and_characters(rows):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    zh = "患者再次服用三百毫克的药物之后凌晨开始寒战并且发热不退需要就医"
    items = rows([(1, "en", " ".join(words), 0), (2, "zh", zh, 0), (3, "en", "too short an item", 0), (4, "en", None, 0), (1, "en", " ".join(words), 0)], ITEM)
    docs = rows(
        [
            (10, "x " + " – ".join(words[:12]).upper() + ". y", 0), (11, " ".join(words[:11]) + " other " + words[11], 0), (12, "\n".join(words[1:13]), 0), (13, "前" + zh[3:27] + "后", 0),
            (14, zh[:12] + "异" + zh[12:], 0), (15, "，".join(zh[:24]), 0), (16, None, 0), (17, "", 0), (18, " ".join(reversed(words)), 0), (19, "a " * 60_000 + " ".join(words), 0), (10, "x " + " – ".join(words[:12]).upper() + ". y", 0),
        ],
        DOC,
    )
    assert {tuple(r) for r in k.leaks(docs, items).collect()} == {(1, 10), (1, 12), (2, 13), (2, 15), (1, 19)}
    assert k.leaks(docs, items.where("false")).count() == k.leaks(docs.where("false"), items).count() == 0


def test_spans_and_cleaning(rows):
    w = [f"t{i}" for i in range(30)]
    items = rows([(1, "en", " ".join(w[:20]), 0), (2, "en", " ".join(w[10:30]), 0)], ITEM)
    text = "Before it. " + ", ".join(w) + "; after it."
    docs = rows([(5, text, 0)], DOC)
    got = {(r["item_id"], text[r["start_pos"] : r["end_pos"]]) for r in k.leaks(docs, items, spans=True).collect()}
    assert got == {(1, ", ".join(w[:20])), (2, ", ".join(w[10:]))}
    r = k.without_leaks(docs, items).first()
    assert r["clean_text"] == "Before it. ; after it." and r["n_items"] == 2


def test_against_containment(rows):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, "en", " ".join(r.choices(vocab, k=25)), 0) for i in range(12)]
    docs = []
    for d in range(40):
        w = r.choices(vocab, k=40)
        if r.random() < 0.5:
            src = items[r.randrange(12)][2].split()
            a = r.randrange(10)
            w[5:5] = src[a : a + r.randint(10, 14)]
        docs.append((d, " ".join(w), 0))
    want = {(i, d) for i, _, t, _ in items for d, x, _ in docs if any(" " + " ".join(t.split()[j : j + 12]) + " " in f" {x} " for j in range(len(t.split()) - 11))}
    assert {tuple(x) for x in k.leaks(rows(docs, DOC), rows(items, ITEM)).collect()} == want


def test_blocks_of_items(rows, monkeypatch):
    monkeypatch.setattr(k, "BLOCK_GRAMS", 10)
    w = [f"t{i}" for i in range(40)]
    items = rows([(i, "en", " ".join(w[i : i + 14]), 0) for i in range(5)], ITEM)
    assert k.leaks(rows([(1, " ".join(w), 0)], DOC), items).count() == 5
