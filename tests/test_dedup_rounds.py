"""Rounds of near-duplicate removal, and what a block of chunks costs."""
import random

from docmill.operators import dedup
from tests.test_dedup import sequential


def test_rounds_widen_by_four(spark):
    """Drifting texts of 16 blocks settle in two rounds, 64 in three."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(700)]
    texts = [" ".join(words[i : i + 40]) for i in range(16 * 17)]
    df = spark.createDataFrame([("d", i, 0, 0, t) for i, t in enumerate(texts)], "doc_name string, page long, seg int, split int, text string")
    found, rounds = dedup.settled(dedup._blocks(df, 17), 0.85, 5)
    assert rounds <= 2
    kept = [f for r in found.orderBy("_blk").collect() for f in r["flags"]]
    assert [i for i, f in enumerate(kept) if f] == sequential(texts, 0.85, 5)


def test_windows_pass_from_block_to_block():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(9)]
    texts = ["", "a", "ab"] + [" ".join(rng.choice(words) for _ in range(6)) for _ in range(400)] + ["x \t Y\x1c z", "X y  Z"]
    greedy = dedup._make_greedy(0.7, 7)
    flags, last = [], []
    for k in range(0, len(texts), 9):
        more, last = greedy(texts[k : k + 9], last, None)
        flags += more
    assert [i for i, f in enumerate(flags) if f] == sequential(texts, 0.7, 7)
