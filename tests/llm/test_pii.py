import random

import numpy as np

from vigilmill.llm import pii
from vigilmill.llm.pii_training import example
from vigilmill.llm.train_pii import held_out

from pii_cases import CASES

TAGGER = pii.Tagger.load()
TABLE = pii.Folds()


def found(text):
    return {(k, text[a:z]) for a, z, k in pii.find([text], TAGGER, TABLE)[0]}


def test_kinds():
    assert ("email", "ana.berg@example.org") in found("You can write to ana.berg@example.org about the rash.")
    assert any(k == "email" for k, _ in found("Email me at ana.berg (at) example (dot) org and I will answer."))
    assert ("phone", "+44 7700 900 123") in found("You can text me on +44 7700 900 123 after work.")
    assert ("phone", "(415) 555-0101") in found("Call my wife at (415) 555-0101 if I do not answer.")
    assert ("id_number", "912-34-5678") in found("SSN 912-34-5678 was printed on the letter.")
    assert ("name", "Maren Lindquist") in found("I saw Dr. Maren Lindquist in the renal unit last week.")
    assert any(k == "address" and t.startswith("12 Mill Lane") for k, t in found("We live at 12 Mill Lane, Fairwick 12345, so the hospital is close."))


def test_traps():
    for t in ("The box says lot 123-45-678.", "On Tuesday night I woke at 2:37 with chills.", "I started it on 2024-03-05 after lunch.", "Fabry Disease and Type Two are different things.", "Dr. Lindquist said to wait.", "Ask u/strip_counter_2 or @renal_770 about it.", "My appointment is on 12 August 2023 at noon."):
        assert found(t) == set(), t


def test_hand_labelled_sentences():
    """Sentences the generator did not make: 0.9 of the spans, 0.9 right."""
    hit = have = want = 0
    for (text, spans), got in zip(CASES, pii.find([t for t, _ in CASES], TAGGER, TABLE), strict=True):
        a, b = {(k, text.index(x)) for k, x in spans}, {(k, s) for s, _, k in got}
        hit, have, want = hit + len(a & b), have + len(b), want + len(a)
    assert hit / want >= 0.9 and hit / have >= 0.9, (hit, have, want)


def test_names_of_any_form():
    """Particles, words of other use, lower case, other scripts."""
    for n in ("Maria de Souza", "Juan de la Cruz", "Will Smith", "Diane Lane", "Marie Le Gall", "Anh Do", "maren lindquist", "Иван Петров"):
        assert ("name", n) in found(f"I saw Dr. {n} in the renal unit last week."), n


def test_form_keeps_what_the_tagger_finds():
    """A tagged particle or listed word doesn't drop a name; a title is cut off."""
    for view, name in (("saw Ludwig van Beethoven here", "Ludwig van Beethoven"), ("saw Dr. Will Smith here", "Will Smith"), ("saw Dr. Smith here", None)):
        tags = np.zeros(len(view), np.int8)
        tags[4:-5] = 2
        tags[4] = 1
        assert [view[a:z] for a, z, _ in pii.spans_of(view, 0, tags)] == ([name] if name else [])


def test_positions_in_disguised_text():
    t = "tel ６６０－５５５－０１９１ ok, and​ I s­aw Dr. Maren Lindquist in the renal unit."
    got = {(k, a) for a, _, k in pii.find([t], TAGGER, TABLE)[0]}
    assert got == {("phone", 4), ("name", t.index("Maren"))}


def test_held_out_accuracy():
    for kind, (hit, have, want) in held_out(TAGGER, [], n=300, seed=4321).items():
        assert hit / want > 0.9 and hit / have > 0.9, (kind, hit, have, want)


def test_gradient():
    """Analytic gradients against differences of the loss."""
    t = pii.Tagger(hidden=3, seed=5)
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64)
    r = np.random.default_rng(1)
    x, y = r.integers(0, pii.VOCAB, (6, 3)), r.integers(0, len(pii.TAGS), (6, 3))
    m = np.ones((6, 3), bool)
    m[4:, 1] = False
    _, g = t.step(x, y, m)
    for k in ("O", "T", "S", "Uf", "Wb", "Bf"):
        i = tuple(r.integers(0, n) for n in t.p[k].shape)
        old, e = t.p[k][i], 1e-3
        t.p[k][i] = old + e
        up = t.step(x, y, m)[0]
        t.p[k][i] = old - e
        down = t.step(x, y, m)[0]
        t.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-2 * max(1, abs(g[k][i])), k


def test_training_learns():
    got = pii.train(96, hidden=12, rate=1e-2)
    assert np.mean(got.losses[-8:]) < 0.5 * np.mean(got.losses[:8])


def test_intervals_give_the_tags_of_the_whole():
    """Viterbi on the intervals that may hold tags equals Viterbi on all."""
    r = random.Random(6)
    texts = [example(r, [])[0] * r.choice((1, 1, 6)) for _ in range(60)]
    views = [pii.codes(pii.folded(t, TABLE)[0]) for t in texts]
    sizes = np.array([len(v) for v in views])
    some = TAGGER.emissions(np.concatenate(views), sizes)
    part = TAGGER.tags(list(some.values()))
    whole = TAGGER.viterbi([s for s, _ in some.values()])
    assert all((a == b).all() for a, b in zip(part, whole, strict=True))
    closed = [k for k in range(len(views)) if k not in some]
    assert all(not x.any() for x in TAGGER.viterbi([TAGGER.scores(views[k][:, None])[:, :, 0] for k in closed]))


def test_windows_agree_with_one_pass():
    """Far from any window's edge, blended scores equal those of the whole."""
    t = "My mother (Owen Quilaga, born in spring) takes it too. " * 6
    v = pii.codes(t)
    whole = TAGGER.scores(v[:, None])[:, :, 0]
    parts = TAGGER.emissions(v, np.array([len(v)]))[0][0]
    assert (whole.argmax(1) == parts.argmax(1)).mean() > 0.97


def test_frames(rows):
    df = rows([("1", "Please ask for Bram Voskeros at the desk.", 5), ("2", None, 5), ("3", "", 5), ("4", "x " * 100_000 + "SSN 912-34-5678 was printed on it.", 5), ("1", "Please ask for Bram Voskeros at the desk.", 5)], "key string, text string, extra int")
    got = sorted(tuple(r) for r in pii.personal_spans(df, TAGGER).collect())
    assert got == [("1", "name", 15, 28), ("1", "name", 15, 28), ("4", "id_number", 200_004, 200_015)]
    masked = {r["key"]: r["masked"] for r in pii.masked_texts(df, TAGGER).collect()}
    assert masked["1"] == "Please ask for [NAME] at the desk." and masked["2"] is None and masked["3"] == ""
    assert pii.personal_spans(df.where("false"), TAGGER).count() == 0


PLAIN = "The swelling came back after the second week and the nurse told us to drink more water before every dose. "


def test_scores_do_not_depend_on_neighbours():
    """Scores and spans of a text are those it has alone, whatever is decoded with it."""
    r = random.Random(8)
    texts = [example(r, [])[0] * r.choice((1, 1, 4)) for _ in range(40)] + ["Ask (ana.berg@example.org)", PLAIN * 9]
    views = [pii.codes(pii.folded(t, TABLE)[0]) for t in texts]
    some = TAGGER.emissions(np.concatenate(views), np.array([len(v) for v in views]))
    assert len(some) > 30
    for k, (s, _) in some.items():
        alone = TAGGER.emissions(views[k], np.array([len(views[k])]))[0][0]
        assert np.allclose(s[:, 1:] - s[:, :1], alone[:, 1:] - alone[:, :1], atol=1e-3), texts[k]
        plain = TAGGER.scores(np.r_[views[k], [97] * pii.TAIL][:, None])[: len(s), :, 0]
        assert np.allclose(s[:, 1:] - s[:, :1], plain[:, 1:] - plain[:, :1], atol=1e-3), texts[k]
    each = [pii.find([t], TAGGER, TABLE)[0] for t in texts]
    assert pii.find(texts + texts[::-1], TAGGER, TABLE) == each + each[::-1]


def test_cost():
    """Hardly more cells are scored than there are characters, and no text comes out for Viterbi that can't have a tag."""
    sizes = np.array([1 + 37 * k % 1500 for k in range(2000)])
    view = pii.codes((PLAIN * (sizes.sum() // len(PLAIN) + 1))[: sizes.sum()])
    cells, tagger = [], pii.Tagger.load()
    tagger.leads = lambda x, w, rows: cells.append(x.size) or pii.Tagger.leads(tagger, x, w, rows)
    tagger.emissions(view, sizes)
    assert sizes.sum() <= sum(cells) < 1.05 * (sizes.sum() + 4 * len(sizes))
    assert TAGGER.emissions(pii.codes(PLAIN * 9), np.array([9 * len(PLAIN)])) == {}


def test_windows_of_long_texts(monkeypatch):
    """Texts that are covered by windows have the spans of one pass."""
    t = PLAIN * 7 + "I saw Dr. Maren Lindquist there. " + PLAIN * 8 + "Call me at (415) 555-0101 after work. " + PLAIN * 3
    assert len(t) < pii.WHOLE
    want = pii.find([t], TAGGER, TABLE)
    assert {t[a:z] for a, z, _ in want[0]} == {"Maren Lindquist", "(415) 555-0101"}
    monkeypatch.setattr(pii, "WHOLE", pii.WINDOW)
    assert pii.find([t], TAGGER, TABLE) == want
