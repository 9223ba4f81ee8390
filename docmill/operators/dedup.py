"""Duplicate removal inside a document: exact copies, then near copies.

Near-duplicate removal is a sequential rule: a chunk is dropped when it
resembles one of the last 50 chunks *kept* before it. Chunks are numbered over
the corpus in order and cut into blocks by these numbers, so a block has at most
``BLOCK_ROWS`` chunks however sparse the page numbers are. All blocks run at
once from an empty window. A block is stale if the window it assumed is not the
one its predecessor ended with. In round r a task takes the stale blocks of
4^r neighbours in turn, each from the window that the one before really ended
with, and skips those that assumed the right one. By induction over the blocks
the state without stale ones is the sequential result; when 4^r covers a document
none is left, so the rounds are the logarithm of the longest document's blocks.

A rerun stops as soon as a whole window of chunks was kept as before. Tasks
stream blocks, and hold one block and one window. What rounds find out is
appended to a log; nothing is rewritten.
"""
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docmill import fixed
from docmill.functions.text import exact_hash, gram_codes
from docmill.operators.numbering import numbered
from docmill.operators.ordering import DOC, PAGE
from docmill.session import cut_lineage, session_setting

ORDER = [PAGE, "seg", "split"]
BLOCK_ROWS = 1024
#: A round takes 2 to this times as many blocks in turn as the one before.
WIDER = 2
#: Blocks that pass to a worker at once.
BLOCKS_PER_BATCH = "8"
_FOUND = "doc_name string, _blk bigint, _round int, assumed string, ended string, tail array<string>, flags array<boolean>"


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """Keep the first of equal chunks (case and outer white space ignored).

    The minimum is combined before the shuffle, so a text copied onto a third of
    all rows costs one row per task."""
    first = F.min(F.struct(*ORDER, "text")).alias("_first")
    return chunks.groupBy(DOC, exact_hash(F.col("text")).alias("_hash")).agg(first).select(DOC, "_first.*")


def _make_greedy(threshold: float, window: int):
    """Function (texts, start window, earlier flags) -> (kept flags, end window)."""
    buckets = 256
    #: text -> grams and sketch of the last window, with which the next block begins
    held: dict = {}

    def grams(text):
        return gram_codes(" ".join(text.lower().split()))

    def sketch(g):
        mixed = (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        return np.bincount(mixed.astype(np.int64), minlength=buckets).astype(np.int32)

    def run(texts, start, earlier):
        size = np.zeros(window, np.int64)
        table = np.zeros((window, buckets), np.int32)
        ring, names, count = [None] * window, [None] * window, 0

        def push(g, s, name):
            nonlocal count
            at = count % window
            ring[at], names[at], size[at], table[at] = g, name, g.size, s
            count += 1

        def resembles(g, s):
            live = min(count, window)
            if not live:
                return False
            total = size[:live] + g.size
            # the bucket overlap is never below the true overlap
            bound = np.minimum(table[:live], s).sum(axis=1, dtype=np.int32)
            maybe = np.nonzero((total == 0) | (bound + 1e-6 >= threshold * (total - bound)))[0]
            # the likeliest first
            for i in maybe[np.argsort(-bound[maybe])].tolist() if maybe.size > 1 else maybe.tolist():
                if total[i] == 0:
                    return True
                every = np.concatenate([ring[i], g])
                every.sort(kind="stable")
                both = np.count_nonzero(every[1:] == every[:-1])
                if both and both / (total[i] - both) >= threshold:
                    return True
            return False

        for text in start:
            if text in held:
                g, s = held[text]
            else:
                g = grams(text)
                s = sketch(g)
            push(g, s, text)
        flags, agreed = [], 0
        for k, text in enumerate(texts):
            g = grams(text)
            s = sketch(g)
            keep = not resembles(g, s)
            flags.append(keep)
            if keep:
                push(g, s, text)
            if earlier is not None:
                # a full window of chunks that both runs kept: the rest is equal
                agreed = 0 if keep != earlier[k] else agreed + int(keep)
                if agreed >= window:
                    flags += list(earlier[k + 1:])
                    break
        held.clear()
        held.update((names[i], (ring[i], table[i].copy())) for i in range(min(count, window)))
        kept = [t for t, f in zip(texts, flags) if f]
        return flags, (list(start) + kept)[-window:]

    return run


def _digest(texts) -> str:
    """Of a window, for comparison."""
    whole = hashlib.md5()
    for t in texts:
        whole.update(t.encode("utf-8", "surrogatepass"))
        whole.update(b"\xff")
    return whole.hexdigest()



def _blocks(chunks: DataFrame, rows_per_block: int) -> DataFrame:
    """One row per block: its chunks, whole, in order."""
    columns = chunks.columns
    placed = numbered(chunks, "_n", DOC, *ORDER)
    packed = F.struct("_n", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("chunk"))
    grouped = placed.groupBy(DOC, F.expr(f"_n div {int(rows_per_block)}").alias("_blk")).agg(F.array_sort(F.collect_list(packed)).alias("_rows"))
    return cut_lineage(grouped.select(DOC, "_blk", F.transform("_rows", lambda r: r["chunk"]).alias("_rows")))


def _walk(work: DataFrame, number: int, threshold: float, window: int) -> DataFrame:
    """Run the blocks of ``work`` (doc_name, _blk, _super, texts, and of earlier
    rounds start, assumed, tail, flags), neighbours of one ``_super`` in turn."""
    greedy, digest = _make_greedy(threshold, window), _digest
    columns = T._parse_datatype_string(_FOUND).names

    def run(frames):
        at, last, before = None, None, None
        for frame in frames:
            out = []
            for doc, blk, part, texts, start, assumed, tail, flags in zip(*(frame[c] for c in ("doc_name", "_blk", "_super", "texts", "start", "assumed", "tail", "flags"))):
                # the block before ended in this task, or in an earlier round
                begin = last if at == (doc, part) and before == blk - 1 else None if start is None else list(start)
                at, before = (doc, part), blk
                if begin is None or assumed is not None and digest(begin) == assumed:
                    if assumed is not None:
                        last = list(tail)
                        continue
                    begin = []
                flags, last = greedy(list(texts), begin, None if flags is None else [bool(f) for f in flags])
                out.append((doc, blk, number, digest(begin), digest(last), last, flags))
            yield pd.DataFrame(out, columns=columns)

    return work.sortWithinPartitions(DOC, "_super", "_blk").mapInPandas(run, _FOUND)


def _work(texts: DataFrame, now: DataFrame, stale: DataFrame, shift: int) -> DataFrame:
    """Blocks of a round with what is known of them, the 2^shift of a ``_super`` in one
    partition: texts move once, and only of parts that have a stale block."""
    part = F.shiftright("_blk", shift).alias("_super")
    # a row per 2^shift blocks
    open_parts = F.broadcast(stale.groupBy(DOC, part).agg(F.min("_blk").alias("_from")))
    opened = texts.withColumn("_super", part).join(open_parts, [DOC, "_super"]).where(F.col("_blk") >= F.col("_from")).drop("_from")
    known = now.drop("ended").join(stale.select(DOC, "_blk", "start"), [DOC, "_blk"], "left").withColumn("_super", part)
    keys = [DOC, "_super"]
    return opened.repartition(*keys).join(known.repartition(*keys).hint("merge"), [*keys, "_blk"])


def settled(blocks: DataFrame, threshold: float, window: int) -> tuple[DataFrame, int]:
    """What the last run of every block found, without stale ones, and the number of rounds."""
    none = {"start": "array<string>", "assumed": "string", "tail": "array<string>", "flags": "array<boolean>"}
    texts = blocks.select(DOC, "_blk", F.transform("_rows", lambda r: r["text"]).alias("texts"))
    spark = blocks.sparkSession
    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BLOCKS_PER_BATCH):
        first = texts.withColumn("_super", F.col("_blk")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        first = first.repartition(F.col(DOC), F.col("_super"))
        rounds, number = [cut_lineage(_walk(first, 0, threshold, window))], 0
        while True:
            log = rounds[0]
            for more in rounds[1:]:
                log = log.unionByName(more)
            now = log.groupBy(DOC, "_blk").agg(F.max_by(F.struct("assumed", "ended", "tail", "flags"), "_round").alias("f")).select(DOC, "_blk", "f.*")
            now = cut_lineage(now)
            ends = now.select(DOC, (F.col("_blk") + 1).alias("_blk"), F.col("ended").alias("_ended"), F.col("tail").alias("start"))
            stale = cut_lineage(now.select(DOC, "_blk", "assumed").join(ends, [DOC, "_blk"]).where("assumed <> _ended").select(DOC, "_blk", "start"))
            if stale.isEmpty():
                return now, number
            number += 1
            shift = WIDER * number
            # partitions by (doc_name, _super) serve the join by (doc_name, _super, _blk) too
            with session_setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
                rounds.append(cut_lineage(_walk(_work(texts, now, stale, shift), number, threshold, window)))


def near_dedup(
    chunks: DataFrame, threshold: float = fixed.DEDUP_THRESHOLD, window: int = fixed.DEDUP_WINDOW,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy near-duplicate removal over (doc_name, page, seg, split, text, ...).

    ``block``: chunks per block, far more than the window."""
    blocks = _blocks(chunks, block)
    found, _ = settled(blocks, threshold, window)
    kept = F.filter("_rows", lambda r, i: F.get("flags", i))
    return blocks.join(found.select(DOC, "_blk", "flags"), [DOC, "_blk"]).select(F.explode(kept).alias("r")).select("r.*")
