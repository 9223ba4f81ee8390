"""Exact top-k cosine retrieval.

A few questions travel with the scan of the vectors. Of more, questions and
vectors are laid out in blocks. A group of ``GROUP`` question blocks is broadcast
as one row to the blocks of vectors, which stay where they are; a task takes one
pair of blocks at a time, as one matrix product, and keeps ``k`` per question. So
the vectors are read once per group, and only the tasks' hits are shuffled.
"""
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docmill import fixed
from docmill.operators.numbering import numbered
from docmill.plans.stats import chunk_type_counts, samples
from docmill.session import cut_lineage, session_setting
from docmill.sources.documents import spread

#: Questions in a block, vectors in a block, question blocks in a group; 512 x 768 doubles are 3 MB.
QUERY_BATCH, VECTOR_BATCH, GROUP = 512, 2048, 16
_HIT = "n bigint, id string, similarity double"


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(lists) -> np.ndarray:
    return _unit(np.stack(list(lists)).astype(np.float64))


def _floors(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a score that ``k`` of its scores reach. Of many columns the best
    of each lane are taken first, so that few are sorted."""
    tops, lanes = scores, max(64, 8 * k)
    if scores.shape[1] >= 4 * lanes:
        tops = scores[:, :lanes].copy()
        for at in range(lanes, scores.shape[1], lanes):
            part = scores[:, at : at + lanes]
            np.fmax(tops[:, : part.shape[1]], part, out=tops[:, : part.shape[1]])
    return -np.partition(-tops, k - 1, 1)[:, k - 1]


def _by_id(ids: np.ndarray) -> np.ndarray:
    """Positions in the order of the ids, null first as in Spark."""
    return np.array(sorted(range(len(ids)), key=lambda at: (ids[at] is not None, ids[at])))


class _Best:
    """The best ``k`` ids of each question; equal scores go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, numbers, ids: np.ndarray, scores: np.ndarray) -> None:
        least = np.array([-own[-1][0] if len(own := self.held.get(n, ())) == self.k else -np.inf for n in numbers])
        found = scores >= least[:, None]  # ties too: ids decide
        if np.count_nonzero(found) > 4 * self.k * len(found):
            found = scores >= np.fmax(_floors(scores, min(self.k, len(ids))), least)[:, None]
        flat = np.flatnonzero(found)
        many = np.flatnonzero(np.bincount(flat // len(ids), minlength=len(found)) > 4 * self.k)
        if len(many):  # ties of many ids
            order = _by_id(ids)
            for r in many:
                at = order[found[r, order]]
                found[r] = False
                found[r, at[np.argsort(-scores[r, at], kind="stable")[: self.k]]] = True
            flat = np.flatnonzero(found)
        rows, cols = np.divmod(flat, len(ids))
        pools: dict = {}
        for r, s, i in zip(rows.tolist(), (-scores[rows, cols]).tolist(), ids[cols].tolist()):
            pools.setdefault(numbers[r], []).append((s, i is not None, i))
        for n, pool in pools.items():
            self.held[n] = sorted(pool + self.held.get(n, []))[: self.k]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(n, i, -s) for n, own in self.held.items() for s, _, i in own], columns=["n", "id", "similarity"])


def _scanned(vectors: DataFrame, wanted: list, k: int) -> DataFrame:
    """The best ``k`` vectors of every partition for each of a few questions."""
    best_of, matrix = _Best, _matrix

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        questions, best = matrix(wanted), best_of(k)
        for batch in batches:
            if not batch.empty:
                best.add(range(len(questions)), batch["id"].to_numpy(), questions @ matrix(batch["embedding"]).T)
        yield best.rows()

    return vectors.mapInPandas(scan, _HIT)


def _met(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of vectors with a group of questions; only the questions move."""
    return chunks.crossJoin(F.broadcast(asked)).select("ids", "data", "ns", "asked")


def _on_a_grid(vectors: DataFrame, questions: DataFrame, count: int, k: int) -> DataFrame:
    """The same for any number of questions (n, embedding)."""
    spark = vectors.sparkSession
    step, size = QUERY_BATCH, QUERY_BATCH * GROUP
    best_of, matrix = _Best, _matrix

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield pd.DataFrame({"ids": [batch["id"].tolist()], "data": [matrix(batch["embedding"]).tobytes()]})

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"g": batch["g"], "ns": [[r["n"] for r in rows] for rows in batch["rows"]], "asked": [matrix([r["embedding"] for r in rows]).tobytes() for rows in batch["rows"]]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = best_of(k)
        for batch in batches:
            for ids, data, ns, asked in zip(batch["ids"], batch["data"], batch["ns"], batch["asked"]):
                x, y = np.frombuffer(asked).reshape(len(ns), -1), np.frombuffer(data).reshape(len(ids), -1)
                for at in range(0, len(ns), step):
                    best.add(ns[at : at + step].tolist(), np.asarray(ids, object), x[at : at + step] @ y.T)
        yield best.rows()

    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(VECTOR_BATCH)):
        chunks = cut_lineage(spread(vectors).mapInPandas(packed, "ids array<string>, data binary"))
    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        asked = questions.groupBy(F.expr(f"n div {size}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "embedding"))).alias("rows"))
        asked = cut_lineage(asked.mapInPandas(blocked, "g bigint, ns array<bigint>, asked binary"))
        hits = [cut_lineage(_met(chunks, asked.where(F.col("g") == g)).mapInPandas(score, _HIT)) for g in range(-(-count // size))]
    return reduce(DataFrame.unionByName, hits)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, id_col: str = "chunk_id", query_id: str = "query_id"
) -> DataFrame:
    """(query_id, id, similarity, rank) of the ``k`` nearest vectors per query.

    Queries are numbered; those with equal ids get an answer each. Up to
    ``QUERY_BATCH`` of them pass the driver, more stay a relation. Ties go to
    the smaller id. Vectors and queries all have an embedding of one length.
    """
    slim = vectors.select(F.col(id_col).cast("string").alias("id"), "embedding")
    asked = cut_lineage(numbered(queries.select(F.col(query_id).cast("string").alias("query_id"), "embedding"), "n"))
    count = asked.count()
    if count <= QUERY_BATCH:
        rows = asked.select("n", "embedding").orderBy("n").collect()
        hits = _scanned(slim, [list(r["embedding"]) for r in rows], k) if rows else slim.sparkSession.createDataFrame([], _HIT)
    else:
        hits = _on_a_grid(slim, asked.select("n", "embedding"), count, k)
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("similarity"), "id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("n", "query_id"), "n").select("query_id", "id", "similarity", "rank")


#: Hits up to this number are broadcast to the store's texts.
MOST_HITS = 10_000


def retrieve(store, texts: list[str], embed, k: int = fixed.TOP_K, preview: int = 800) -> DataFrame:
    """Answer text queries from a store, with previews of the chunks found. A
    text that is asked twice is answered once."""
    spark = store.spark
    texts = list(dict.fromkeys(texts))
    queries = spark.createDataFrame([(t,) for t in texts], "query_id string").withColumn(
        "embedding", embed(F.col("query_id"))
    )
    hits = top_k(store.read(columns=["chunk_id", "embedding"]), queries, k).withColumnRenamed("id", "chunk_id")
    if len(texts) * k <= MOST_HITS:
        hits = F.broadcast(hits)
    chunks = store.read(columns=["chunk_id", "chunk_type", "doc_name", "page", "text"])
    return (
        chunks.join(hits, "chunk_id")
        .select("query_id", "rank", "similarity", "chunk_id", "chunk_type", "doc_name", "page",
                F.left("text", F.lit(preview)).alias("preview"))
        .orderBy("query_id", "rank")
    )


def session_report(store, texts: list[str], embed) -> dict[str, DataFrame]:
    """What a retrieval session shows: type counts, sample specs and answers."""
    chunks = store.read(columns=["chunk_id", "chunk_type", "text"])
    return {
        "counts": chunk_type_counts(chunks).orderBy("chunk_type"),
        "samples": samples(chunks, "spec_row", 3, 800),
        "answers": retrieve(store, texts, embed),
    }
