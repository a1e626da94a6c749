"""The batched shift search against the same search with every distance worked out on its own."""

import random

import numpy as np
import pytest

from scorelake.operators import translation as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def searched(hyp, ref):
    ids = {}
    hyp, ref = [ids.setdefault(w, len(ids)) for w in hyp], [ids.setdefault(w, len(ids)) for w in ref]
    if not ref:
        return len(hyp)
    shifts = 0
    while True:
        now, best = edits(hyp, ref), None
        if not now:
            return shifts
        for length, start, goes in T._shifts(hyp, ref, T._tables([(hyp, ref)])[0]):
            moved = T._moved(hyp, length, start, goes)
            if moved != hyp:
                best = max(best or (0,), (now - edits(moved, ref), length, -start, -goes))
        if best is None or best[0] <= 0:
            return shifts + now
        shifts, hyp = shifts + 1, T._moved(hyp, best[1], -best[2], -best[3])


def pairs():
    rng = random.Random(8)
    out = [([], []), (["a"], []), ([], ["a", "b"]), ("a b c".split(), "a b c".split())]
    for size in (3, 6, 20):
        words = [f"w{i}" for i in range(size)]
        out += [([rng.choice(words) for _ in range(rng.randrange(18))], [rng.choice(words) for _ in range(rng.randrange(18))]) for _ in range(40)]
    for _ in range(10):
        text = [f"w{rng.randrange(30)}" for _ in range(30)]
        cut = rng.randrange(30)
        out.append((text[cut:] + text[:cut], text))
    return out


@pytest.mark.parametrize("cells", [T.CELLS, 50])
def test_side_by_side_equals_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    given = pairs()
    assert T._ter_edits_of(given) == [searched(*p) for p in given]
    number = {w: i for i, w in enumerate(sorted({w for p in given for side in p for w in side}))}
    tables = T._tables([tuple([number[w] for w in side] for side in p) for p in given])
    for table, (hyp, ref) in zip(tables, given):
        assert table.shape == (len(hyp) + 1, len(ref) + 1) and table[-1, -1] == edits(hyp, ref)


def test_counts_take_the_best_reference(monkeypatch):
    monkeypatch.setattr(T, "TEXTS", 2)
    preds = ["A b c", "x", "d a b c", "q"]
    refs = [["a b c", "z"], ["x y z w"], ["a b c d"], ["q", "q q q"]]
    assert np.allclose(T._ter_counts(preds, refs), [[0, 2], [3, 4], [1, 4], [0, 2]])
