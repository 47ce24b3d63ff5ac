import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from vigilmill.llm import visual as v

TEXTS = "space string, id string, text string, extra int"


def test_fold():
    assert v.fold("ｅｘａｍｐｌｅ　１２") == "example 12"
    assert v.fold("ﬁne Af\xadter jog‎ging on ") == "fine After jogging on"
    assert v.fold("é") == "é" and v.fold("résumé") == v.fold("résumé")
    for a, b in (("A", "a"), ("e", "é"), ("1", "2"), ("a b", "a\nb"), ("x²", "x2"), ("½", "1/2"), ("a.", "a,"), ("…", ".")):
        assert v.fold(a) != v.fold(b)
    assert v.fold("​  ") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_fold_is_idempotent(t):
    f = v.fold(t)
    assert v.fold(f) == f and unicodedata.normalize("NFC", f) == f


def test_suspects():
    assert v.suspects("Quоrajan helped а lot") == ["Quоrajan", "а"]
    assert v.suspects("Спасибо большое") == []
    assert v.suspects("Это оса и мед") == []  # look-alikes alone, but in a Cyrillic text
    assert v.look("Quоrajan") == "Quorajan"


def test_repair_needs_the_vocabulary(rows):
    texts = rows([("the drug Quorajan",), ("plain",)], "text string")
    tokens = rows([("Quоrajan",), ("Zоzozo",), ("Wоrdа",), ("Wordа",)], "token string")
    got = {tuple(r) for r in v.repairs(tokens, v.vocabulary(texts)).collect()}
    assert got == {("Quоrajan", "Quorajan"), ("Wоrdа", "Worda"), ("Wordа", "Worda")}


def test_pairs(rows):
    df = rows(
        [
            ("posts", "a", "took Quorajan today", 1), ("posts", "b", "took Quоrajan today", 1), ("posts", "c", "took Quorajan today ", 1), ("posts", "d", "took Quorajan  today", 1),
            ("comments", "e", "took Quоrajan today", 1), ("posts", "a", "took Quorajan today", 1), ("posts", None, "took Quоrajan today", 1), ("posts", "f", None, 1), ("posts", "g", "", 1), ("posts", "h", "​ ", 1),
            ("posts", "i", "took quorajan today", 1), ("posts", "a2", "took Quorajan today", 1), ("posts", "b", "took Quorajan​ today", 1),
        ],
        TEXTS,
    )
    m = v.look_alike_classes(df)
    got = {tuple(r) for r in v.look_alike_pairs(m).collect()}
    assert got == {("posts", x, y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"), ("a2", "b"), ("a2", "c"))}
    assert {tuple(r) for r in v.look_alike_pairs(m, block=1).collect()} == got
    assert v.look_alike_pairs(v.look_alike_classes(df.where("false"))).count() == 0


def test_consistent_texts(rows):
    df = rows([("s", "1", "Quоrajan ｏk", 1), ("s", "2", "Quorajan", 2), ("s", "3", None, 3), ("s", "3", None, 3), ("s", "4", "x" * 100_000, 4)], TEXTS)
    got = sorted((r["id"], r["text"], r["extra"]) for r in v.consistent_texts(df, "text").collect() if r["text"] is not None)
    assert got == [("1", "Quorajan ok", 1), ("2", "Quorajan", 2), ("4", "x" * 100_000, 4)]
    assert v.consistent_texts(df, "text").count() == 5
    clash = df.withColumnsRenamed({"extra": "_raw", "space": "_form"})
    assert v.consistent_texts(clash, "text").columns == clash.columns


def test_repair_towards_the_dominant_script(rows):
    """Latin letters in Cyrillic words, accents on look-alikes, further alphabets."""
    assert v.plain_form("Cпасибо") == "Спасибо" and v.plain_form("nӧw") == "nöw" and v.plain_form("Ꭺspirin") == "Aspirin" and v.plain_form("drαg") == "drag"
    assert v.suspects("Спасибо за ответ") == [] and v.suspects("это всё, спасибо") == []
    texts = ["Спасибо за ответ", "Cпасибо за ответ", "take Aspirin now", "take Ꭺspirin now", "a drag", "a drαg", "nöw or later", "nӧw or later"]
    df = rows([("s", str(k), t, k) for k, t in enumerate(texts)], TEXTS)
    got = {tuple(r)[1:] for r in v.look_alike_pairs(v.look_alike_classes(df)).collect()}
    assert got == {("0", "1"), ("2", "3"), ("4", "5"), ("6", "7")}
    assert {r["text"] for r in v.consistent_texts(df, "text").collect()} == set(texts[::2])
