import random

from vigilmill.llm import sentences as s
from vigilmill.llm.sentence_seeds import SEEDS

DOC = "doc_id bigint, text string, extra int"
TAGGER = s.trained_tagger()

HELD_OUT = [
    ("Mr. Bell called at 7 p.m. He was late.", 2), ("It rose to 3.7 in May. Is that bad? No!", 3), ("She said: \"Go home. Rest well.\" and left.", 1), ("He asked: \"Why?\" Nobody knew.", 2), ("(See page 4.) It is fine.", 2),
    ("Title of the page\n\nFirst line that is\nwrapped here. Second one.", 3), ("Do this:\n- one\n- two. \n- three?\nThen stop.", 5), ("1. first\n2. second\n3. third", 3), ("I waited... and waited. Then it came.", 2), ("Visit www.a-b.example/x.y?z=1.5 now. OK.", 2),
    ("Am 5. Mai kam Dr. Roth. Es ging gut.", 2), ("Elle a dit « Venez. Vite ! » et elle rit. Bon !", 2), ("¿Qué pasa? ¡Nada! El Sr. Gil no vino.", 3), ("他说：“好。明天见。”然后走了。真的吗？", 2), ("（这是注释。）下一句。", 2), ("彼は「はい。行きます。」と答えた。終わり。", 2),
    ("उसने कहा, \"रुको। आओ।\" और गया। ठीक है।", 2), ("ฉันไปตลาด เขาอยู่บ้าน\nวันนี้ฝนตก", 3), ("The pH was 7.4. pH rises later.", 2), ("", 0), ("  \n\n ", 0), ("no punctuation at all", 1), ("...", 1), ("Wait.What?", 1),
]


def test_held_out():
    wrong = [(t, [t[a:z] for a, z in s.split_units(t, TAGGER)]) for t, n in HELD_OUT if len(s.split_units(t, TAGGER)) != n]
    assert len(wrong) <= 1, wrong


def test_composed_accuracy():
    r, n, bad = random.Random(1234), 0, 0
    for lang in [k for k in SEEDS if k not in ("heading", "item")] * 20:
        f, gold = s.labelled(*s.compose(r, SEEDS, lang))
        n += len(gold)
        bad += sum(a != b for a, b in zip(gold, TAGGER.decode(f)))
    assert bad / n < 0.005


def test_viterbi_is_the_best_path():
    t = s.BoundaryTagger()
    t.w, t.t = {"a": 1.0, "b": -0.5, "c": 0.3}, [[0.1, -0.2], [0.4, -2.0]]
    feats = [("a",), ("c",), ("a",), ("b",), ("a",)]

    def score(tags):
        return sum(t.emission(f) * g for f, g in zip(feats, tags)) + sum(t.t[x][y] for x, y in zip(tags, tags[1:]))

    every = [[k >> i & 1 for i in range(5)] for k in range(32)]
    assert t.decode(feats) == max(every, key=score)


def test_units_cover_the_text(rows):
    r = random.Random(5)
    texts = [s.compose(r, SEEDS, lang)[0] for lang in ("en", "de", "zh", "th", "hi")] + [None, "", " ", "x" * 200_000, "a. " * 20_000, "„(«“\"'" * 50, "\x00퟿"]
    df = rows([(i, t, 1) for i, t in enumerate(texts)], DOC)
    got = {}
    for u in s.sentence_units(df, TAGGER).collect():
        got.setdefault(u["doc_id"], []).append((u["unit_no"], u["start_pos"], u["end_pos"]))
    for i, t in enumerate(texts):
        units = sorted(got.get(i, []))
        assert "".join("".join(t[a:z].split()) for _, a, z in units) == "".join((t or "").split())
        assert all(t[a:z] == t[a:z].strip() and z > a for _, a, z in units)
        assert [n for n, *_ in units] == list(range(len(units)))
    assert s.sentence_units(df.where("false"), TAGGER).count() == 0


def test_stored_tagger_is_the_trained_one():
    stored = s.stored_tagger()
    for t, _ in HELD_OUT:
        assert s.split_units(t, stored) == s.split_units(t, TAGGER)


def test_units_with_text_and_columns(rows):
    df = rows([(1, "One here. Two there.", "en", 5), (2, None, "de", 5), (1, "One here. Two there.", "en", 5)], "doc_id bigint, text string, lang string, extra int")
    got = sorted(tuple(r) for r in s.sentence_units(df, with_text=True, keep=("lang",)).select("doc_id", "lang", "unit_no", "unit").collect())
    assert got == [(1, "en", 0, "One here."), (1, "en", 0, "One here."), (1, "en", 1, "Two there."), (1, "en", 1, "Two there.")]
