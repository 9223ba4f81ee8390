"""Greedy near-duplicate removal against the rule written out directly."""
import random
import re

from pyspark.sql import functions as F

from docmill.operators import dedup


def shingles(text):
    flat = re.sub(r"\s+", " ", text.lower().strip())
    return {flat[i:i + 3] for i in range(len(flat) - 2)}


def sequential(texts, threshold, window):
    kept = []
    for i, text in enumerate(texts):
        mine = shingles(text)
        recent = [shingles(texts[k]) for k in kept[-window:]]
        if not any((len(mine & o) / len(mine | o) if mine | o else 1.0) >= threshold for o in recent):
            kept.append(i)
    return kept


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            old = rng.choice(texts[-12:]).split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(40)))
    return texts


def run(spark, docs, block, threshold, window):
    rows = [(d, i, 0, 0, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_name string, page long, seg int, split int, text string")
    out = dedup.near_dedup(df, threshold, window, block).select("doc_name", "page").collect()
    return {d: sorted(r["page"] for r in out if r["doc_name"] == d) for d in docs}


def test_blocks_give_the_sequential_result(spark):
    docs = {"a": corpus(160, 1), "b": corpus(7, 2), "c": ["ab", "x", "ab c"]}
    for block, window in ((8, 5), (40, 10), (1000, 5)):
        want = {d: sequential(t, 0.8, window) for d, t in docs.items()}
        assert len(want["a"]) < 150
        assert run(spark, docs, block, 0.8, window) == want


def test_rounds_of_drifting_texts(spark):
    """Each text resembles the few before it, so every block depends on the first."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1200)]
    texts = [" ".join(words[i : i + 40]) for i in range(1100)]
    for blocks in (8, 64):
        rows = [("d", 10**6 * i, 0, 0, t) for i, t in enumerate(texts[: 17 * blocks])]
        df = spark.createDataFrame(rows, "doc_name string, page long, seg int, split int, text string")
        cut = dedup._blocks(df, 17)
        found, rounds = dedup.settled(cut, 0.85, 5)
        assert cut.count() == blocks and 1 < rounds <= blocks.bit_length()
        kept = [f for r in found.orderBy("_blk").collect() for f in r["flags"]]
        assert [i for i, f in enumerate(kept) if f] == sequential(texts[: 17 * blocks], 0.85, 5)


def test_blocks_of_sparse_and_dense_files(spark):
    rows = [("sparse", 10**7 * i, 0, 0, f"text {i}") for i in range(5)] + [("dense", 1, 0, i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_name string, page long, seg int, split int, text string").withColumn("vendor", F.lit("x"))
    sizes = {}
    for r in dedup._blocks(df, 20).select("doc_name", F.size("_rows").alias("n")).collect():
        sizes.setdefault(r["doc_name"], []).append(r["n"])
    assert max(sizes["dense"]) <= 20 and len(sizes["dense"]) >= 5 and sum(sizes["dense"]) == 100 and sum(sizes["sparse"]) == 5
    assert dedup.near_dedup(df).columns == df.columns and dedup.near_dedup(df.limit(0)).count() == 0


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(
        [("d", 2, 0, 0, "Same text"), ("d", 1, 0, 1, " same TEXT　"), ("e", 1, 0, 0, "same text"), ("d", 1, 0, 0, "other")],
        "doc_name string, page long, seg int, split int, text string",
    )
    got = {(r["doc_name"], r["page"], r["split"]) for r in dedup.exact_dedup(df).collect()}
    assert got == {("d", 1, 1), ("e", 1, 0), ("d", 1, 0)}
