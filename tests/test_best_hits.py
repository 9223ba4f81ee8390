"""The best hits of blocks that come one after another, next to a plain sort of all."""
import numpy as np
import pytest

from docmill.plans.retrieval import _Best


def _sorted(ids, scores, k):
    found = {}
    for n, row in enumerate(scores.tolist()):
        hits = sorted((-s, i is not None, i or "", i) for s, i in zip(row, ids) if s == s)[:k]
        found[n] = [(i, -s) for s, _, _, i in hits]
    return found


@pytest.mark.parametrize("width", [2, 50, 700])
@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("kind", ["distinct", "ties", "rising", "not a number"])
def test_blocks_give_what_a_sort_gives(width, k, kind):
    rng = np.random.default_rng(width + k)
    scores = rng.normal(size=(9, 2100))
    if kind == "ties":
        scores = rng.integers(0, 3, size=(9, 2100)) / 2
    elif kind == "rising":
        scores = np.sort(scores, axis=1)
    elif kind == "not a number":
        scores[:, rng.random(2100) < 0.5] = np.nan
    ids = np.array([None if i % 300 == 7 else str(i) for i in rng.permutation(2100)], object)
    best = _Best(k)
    for at in range(0, 2100, width):
        best.add(range(9), ids[at : at + width], scores[:, at : at + width])
    rows = best.rows()
    got = {n: list(zip(own["id"].tolist(), own["similarity"].tolist())) for n, own in rows.groupby("n")}
    assert got == _sorted(ids, scores, k)
