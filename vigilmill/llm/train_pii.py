"""Train the tagger anew: python -m vigilmill.llm.train_pii MODEL.npz TEXTS.parquet:COLUMN...

Labels come from composed texts (pii_training), new ones at each step.
Background sentences come from the first BACKGROUND rows of each given table in
hash order. Training has two parts; before the second, sentences of the
background in which the tagger finds anything are mixed in several times (hard
negatives). Takes some ten minutes on 8 cores. With --on only the second part
runs, from the given model; the stored model had it three times, the last on
runs of sentences instead of single ones.
"""

from __future__ import annotations

import os
import random
import sys
import time
from hashlib import blake2b

for _v in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_v, "1")

import pyarrow.parquet as pq  # noqa: E402

from .pii import Folds, Tagger, find, plain_pieces, train  # noqa: E402
from .pii_training import example  # noqa: E402

BACKGROUND = 10000
STEPS, ON_STEPS, RATE, ON_RATE, PROCESSES = 2000, 1000, 8e-3, 5e-3, 8


def held_out(tagger: Tagger, background: list[str], n: int = 1500, seed: int = 77) -> dict[str, tuple[int, int, int]]:
    """Per type: spans found with the right start, found in all, wanted."""
    r = random.Random(seed)
    data = [example(r, background) for _ in range(n)]
    got = find([t for t, _ in data], tagger, Folds())
    out: dict[str, tuple[int, int, int]] = {}
    for (_, spans), g in zip(data, got, strict=True):
        want, have = {(a, k) for a, _, k in spans}, {(a, k) for a, _, k in g}
        for k in {k for _, k in want | have}:
            x = out.get(k, (0, 0, 0))
            w, h = {s for s in want if s[1] == k}, {s for s in have if s[1] == k}
            out[k] = (x[0] + len(w & h), x[1] + len(h), x[2] + len(w))
    return out


def main(args: list[str]) -> None:
    on = "--on" in args
    args = [a for a in args if a != "--on"]
    background = []
    for arg in args[1:]:
        path, column = arg.rsplit(":", 1)
        texts = [t for t in pq.read_table(path, columns=[column])[column].to_pylist() if t]
        texts.sort(key=lambda t: blake2b(t.encode(), digest_size=8).digest())
        background += plain_pieces(texts[:BACKGROUND])
    print(len(background), "background sentences", flush=True)
    began = time.time()
    report = lambda n, loss: print("step", n, round(loss, 4), round(time.time() - began), "s", flush=True)
    tagger = Tagger.load(args[0]) if on else train(STEPS, background=background, report=report, rate=RATE, processes=PROCESSES)
    # No surface of the background is sure to be personal, so what is found in it is most likely wrong.
    hard = [p for p, f in zip(background, find(background, tagger, Folds()), strict=True) if f]
    print(len(hard), "hard negatives", flush=True)
    tagger = train(ON_STEPS, seed=5, background=background + hard * max(1, len(background) // max(1, 8 * len(hard))), report=report, start=tagger, rate=ON_RATE, processes=PROCESSES)
    tagger.save(args[0])
    print(held_out(Tagger.load(args[0]), background))


if __name__ == "__main__":
    main(sys.argv[1:])
