"""How the filters of a corpus interact: what each removes in every order of them.

A document fails a set of filters, its mask. In one order it is removed by the
first filter of its mask; whatever comes later would have failed it too. Orders
are numbered lexicographically (their Lehmer rank), so all orders that begin
alike have neighbouring numbers: those that remove a mask at a step by a filter
are the ones that begin with some filters outside the mask and then this one,
and each such beginning is one interval. A mask's counts are added where its
intervals begin and taken away where they end; one prefix sum over the ranks
gives what is removed at every step of every order.

Texts are read once, by a narrow step that gives a mask and a digest. All else
works on counts: copies are grouped with partial sums, so a text that a third
of all rows hold is one row per task, and a part has at most 32 masks. Each
measure is a sum of integers, independent of the order of rows.

Null keys, texts and parts: a null text is empty, a null part is '', a null key
has no label and no smaller key. Repeated rows count as often as they stand
there; a key with several labels is good (toxic) if any of them says so. Without
documents there are no rows.
"""
import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: A: few words, B: repeated words, C: many capitals, D: signs of markup, E: a copy.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_CAPITALS = bytes(range(65, 91))
_LATER_BYTES = bytes(range(0x80, 0xC0))
_SIGNS = (b"#", b"$", b"%", b"&", b"*", b"|")


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: at space and \t to \r
    points = len(text.translate(None, _LATER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | any(s in text for s in _SIGNS) << 3
    )


def masks(docs: DataFrame, key: Column, part: Column, text: Column) -> DataFrame:
    """``key``, ``part``, ``mask`` (A to D) and ``digest`` (of the whole text) of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found, digests = np.zeros(len(texts), np.int32), []
            for i, value in enumerate(texts):
                t = value.as_py()
                found[i] = mask_of(t)
                digests.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array(digests, pa.binary())], names=["key", "part", "mask", "digest"]
            )

    rows = docs.select(key.alias("key"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, part string, mask int, digest binary")


def with_copies(found: DataFrame, marks: DataFrame) -> DataFrame:
    """``part``, ``mask`` with the bit of filter E, and the counts ``n``, ``good``, ``toxic`` of its documents.

    ``marks``: one row per key with the booleans ``good`` and ``toxic``.
    """
    each = found.groupBy("key", "part", "mask", "digest").agg(F.count("*").alias("n"))
    each = each.join(marks, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    groups = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("keyless"), first.alias("first")
    )
    # rows per digest: parts x 4 labels at most
    least = F.min("first.key").over(Window.partitionBy("digest"))
    groups = groups.withColumn("least", least)
    own = F.col("keyless") + F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(
        F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n"))
    ))
    rows = groups.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )


def intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders of ``n`` filters that
    remove ``mask`` at this step, for every beginning that does so."""
    out = []

    def walk(free: list[int], rank: int):
        size = factorial(len(free) - 1) if free else 0
        for i, f in enumerate(free):
            at = rank + i * size
            if mask >> f & 1:
                out.append((n - len(free), at, at + size))
            else:
                walk(free[:i] + free[i + 1 :], at)

    walk(list(range(n)), 0)
    return out


def removals(counts: dict[int, np.ndarray], n: int) -> np.ndarray:
    """[step, rank, measure]: what every order removes at every step; ``counts`` by mask."""
    width = len(next(iter(counts.values()), np.zeros(1)))
    steps = np.zeros((n, factorial(n) + 1, width), np.int64)
    for mask, values in counts.items():
        for step, first, end in intervals(mask, n):
            steps[step, first] += values
            steps[step, end] -= values
    return steps.cumsum(1)[:, :-1]


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step from ``part``, ``mask``, ``n``, ``good``, ``toxic``."""
    n = len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    letters = np.array([[filters.index(c) for c in o] for o in orders]).T  # [step, rank]
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley filter".split()
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:-1]) + ", filter string"

    def run(key, table):
        rows = {int(m): np.array(v, np.int64) for m, *v in zip(*(table.column(c).to_pylist() for c in ("mask", "n", "good", "toxic")))}
        gone = removals(rows, n)
        removed = gone[:, :, 0]
        total = sum(int(v[0]) for v in rows.values())
        fails = np.array([sum(int(v[0]) for m, v in rows.items() if m >> f & 1) for f in range(n)])
        alone = np.array([int(rows[1 << f][0]) if 1 << f in rows else 0 for f in range(n)])
        worth = np.array([removed[letters == f].sum() for f in range(n)])
        flat = lambda x: pa.array(np.ascontiguousarray(x.T).ravel())
        columns = [
            pa.array([key[0].as_py()] * (n * len(orders))), pa.array(np.repeat(orders, n).tolist()),
            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
            flat(total - removed.cumsum(0)), flat(removed), flat(fails[letters] - removed), flat(alone[letters]),
            flat(gone[:, :, 1]), flat(gone[:, :, 2]), flat(worth[letters]), pa.array(list("".join(orders))),
        ]
        return pa.Table.from_arrays(columns, names=names)

    return counts.groupBy("part").applyInArrow(run, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """What the five filters remove, in all orders, per part of ``docs``.

    ``labels``: ``key``, ``quality`` and ``toxic``.
    """
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    return interactions(with_copies(masks(docs, F.col(key), F.col(part), F.col(text)), marks))
