"""Approximate nearest neighbours by inner product over balanced posting lists.

* Equal vectors are one, with its smallest ids: a query needs no more of them
  than it returns, and its own.
* Vectors get one more component, so that all are equally long and the largest
  inner product is the smallest distance.
* Centroids come from k-means with a penalty on large clusters, on a sample of
  at most ``MOST_SAMPLE`` vectors; there is one for ``PER_LIST`` vectors, at
  most ``MOST_LISTS``, so they are of bounded size and broadcast.
* Every vector goes to the list of its closest centroid, and a vector near a
  boundary also to others within ``NEAR`` times that distance, but not to one
  that lies closer to a list chosen before than to the vector.
* A query takes all lists within ``FAR`` times the distance up to which the
  closest lists hold enough vectors for an answer, however many these are.
* Neighbouring small lists share a bin. Bins and their queries meet in blocks of
  about ``BLOCK`` rows, so a large list or a popular one is many small tasks and
  a query goes once to each bin; a block yields each query's best few.

Scores are inner products of the original vectors in double precision.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docmill.session import cut_lineage

MOST_SAMPLE, PER_LIST, MOST_LISTS = 40_000, 64, 4096
COPIES, NEAR, FAR, BLOCK = 4, 1.1, 1.35, 4096


@dataclass
class Lists:
    """Centroids in the longer space."""

    centroids: np.ndarray
    length: float

    @staticmethod
    def build(sample: np.ndarray, count: int, length: float, seed: int = 3) -> "Lists":
        random = np.random.default_rng(seed)
        x = lengthened(sample, length)
        c = x[random.choice(len(x), min(count, len(x)), False)]
        sizes = np.full(len(c), len(x) / len(c))
        for _ in range(12):
            sums, new = np.zeros(c.shape), np.zeros(len(c))
            for k in range(0, len(x), 2048):
                d = _distances(x[k : k + 2048], c)
                own = (d + 0.01 * length**2 * (sizes / sizes.mean() - 1).clip(0)).argmin(1)  # large ones draw less
                np.add.at(sums, own, x[k : k + 2048])
                new += np.bincount(own, minlength=len(c))
            c = np.where(new[:, None] > 0, sums / new.clip(1)[:, None], x[random.choice(len(x), len(c))]).astype(np.float32)
            sizes = new
        # near ones get near numbers: by the closest of a few of them
        few = _distances(c, c[random.choice(len(c), int(len(c) ** 0.5), False)])
        return Lists(c[np.lexsort((few.min(1), few.argmin(1)))], length)

    def homes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector: the closest, and others across a boundary."""
        d = _distances(lengthened(vectors, self.length), self.centroids)
        out = []
        for far in d:
            own = np.flatnonzero(far <= NEAR**2 * far.min())
            own = own[np.argsort(far[own], kind="stable")]
            far = far[own]
            chosen = [own[0]]
            for i, f in zip(own[1:], far[1:]):
                if len(chosen) == COPIES:
                    break
                if (((self.centroids[chosen] - self.centroids[i]) ** 2).sum(1) > f).all():
                    chosen.append(i)
            out.append(np.array(chosen))
        return out

    def of_queries(self, vectors: np.ndarray, far: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists within ``far`` times the distance of the closest ones that hold ``least`` rows."""
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        x = np.concatenate([vectors / size * self.length, np.zeros((len(vectors), 1))], 1).astype(np.float32)
        d = _distances(x, self.centroids)
        order = np.argsort(d, 1, kind="stable")
        enough = (np.cumsum(sizes[order], 1) < least).sum(1).clip(max=len(sizes) - 1)
        bound = far**2 * np.take_along_axis(d, order, 1)[np.arange(len(d)), enough]
        return [np.flatnonzero(own <= most) for own, most in zip(d, bound)]


def in_bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each list, and the number of blocks its bin is cut into: small
    lists are put together up to about ``BLOCK`` rows, a large one is its own."""
    large = sizes > BLOCK
    before = np.cumsum(np.where(large, 0, sizes)) - np.where(large, 0, sizes)
    bins = np.where(large, before[-1] // BLOCK + np.cumsum(large), before // BLOCK)
    return bins, np.where(large, -(-sizes // BLOCK), 1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (x @ c.T)).clip(0)


def lengthened(x: np.ndarray, length: float) -> np.ndarray:
    rest = np.sqrt((length**2 - (x.astype(np.float64) ** 2).sum(1)).clip(0))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` of the rows that take part: key and vector not null, no
    component null, infinite or NaN, not all zero; of the length that most have."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            far: float = FAR) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: for each of the
    queries (a column ``key`` of ids of ``df``) up to ``k`` other rows of large
    inner product, best first, of equal ones the smaller id.

    Ids are unique; of rows that repeat an id, the result may name it twice.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    by_vector = Window.partitionBy("h").orderBy("id")
    # the limit on the rank is applied before the shuffle too, so copies don't meet in one task
    hashed = rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b")))
    few = hashed.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    few = cut_lineage(few)
    vectors = cut_lineage(few.where("n = 1").select("h", F.col("id").alias("rep"), "v"))
    members = few.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    asked = hashed.join(queries.select(F.col(f"`{key}`").alias("id")).distinct(), "id", "left_semi").select("id", "h")
    asked = cut_lineage(asked.join(vectors.select("h", "rep"), "h").select("id", "rep"))

    count, length = vectors.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not count:
        return spark.createDataFrame([], result)
    share = min(1.0, MOST_SAMPLE / count)
    sampled = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
    sample = np.array([r[0] for r in sampled.select("v").toLocalIterator()])
    size = sample.shape[1]
    shared = spark.sparkContext.broadcast(Lists.build(sample, max(1, min(MOST_LISTS, count // PER_LIST)), length))

    def listed(choose):
        """Rows (number, lists, rep, v) of what is chosen for each vector: pairs of a number and lists."""
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = choose(shared.value, _matrix(part.column(1), size))
                    row = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                    pairs = [p for f in found for p in f]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([n for n, _ in pairs], pa.int32()), pa.array([x for _, x in pairs], pa.list_(pa.int32())), *part.take(pa.array(row)).columns,
                    ], names=["n", "lists", "rep", "v"])
        return run

    schema = "n int, lists array<int>, rep bigint, v array<double>"
    posts = cut_lineage(vectors.select("rep", "v").mapInArrow(listed(lambda lists, x: [[(i, [i]) for i in own] for own in lists.homes(x)]), schema))
    sizes = np.zeros(len(shared.value.centroids), np.int64)
    for i, c in posts.groupBy("n").agg(F.count(F.lit(1))).collect():  # a row for each list
        sizes[i] = c
    bins, parts = in_bins(sizes)

    def wanted(lists, x):
        for own in lists.of_queries(x, far, sizes, COPIES * (k + 1)):
            own = own[sizes[own] > 0]
            own = own[np.argsort(bins[own], kind="stable")]
            yield [(bins[part[0]], part) for part in np.split(own, np.flatnonzero(np.diff(bins[own])) + 1)]

    asking = vectors.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    asks = cut_lineage(asking.mapInArrow(listed(lambda lists, x: list(wanted(lists, x))), schema)).withColumnRenamed("n", "bin")
    places = spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(bins, parts))], "n int, bin int, p int")
    queued = asks.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q"))
    both = places.select("bin", "p").distinct().join(queued, "bin")  # a row for each bin
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = posts.join(places.select("n", "bin"), "n").join(both, "bin")
    met = (
        own.select("bin", deal("p").alias("i"), every("q").alias("j"), F.lit(0).alias("asks"), "lists", "rep", "v")
        .union(asks.join(both, "bin").select("bin", every("p").alias("i"), deal("q").alias("j"), F.lit(1).alias("asks"), "lists", "rep", "v"))
        .repartition("bin", "i", "j").sortWithinPartitions("bin", "i", "j", "asks")
    )

    def best(batches):
        key, own, waiting = None, [], []

        def scored():
            if not own or not waiting:
                return
            ids, lists, v = (np.concatenate([o[c] for o in own]) for c in range(3))
            names, column = np.unique(lists, return_inverse=True)
            for q_ids, q_lists, q in waiting:
                for at in range(0, len(q), 256):
                    chosen = np.array([np.isin(names, x) for x in q_lists[at : at + 256]])
                    s = np.where(chosen[:, column], q[at : at + 256] @ v.T, -np.inf)
                    n = min(COPIES * (k + 1), len(ids))  # a vector may be here once in each of its lists
                    least = -np.partition(-s, n - 1, 1)[:, n - 1]
                    for q_id, row, low in zip(q_ids[at : at + 256], s, least):
                        top = np.flatnonzero((row >= low) & (row > -np.inf))
                        top = top[np.lexsort((ids[top], -row[top]))]
                        top = top[np.sort(np.unique(ids[top], return_index=True)[1])][: k + 1]
                        yield np.full(len(top), q_id), ids[top], row[top]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["q", "rep", "score"])

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if key != tuple(marks[a, :3]):
                    if found := list(scored()):
                        yield out(found)
                    key, own, waiting = tuple(marks[a, :3]), [], []
                part = batch.slice(a, b - a)
                lists, rows = part.column(4), (part.column(5).to_numpy(), _matrix(part.column(6), size))
                if marks[a, 3]:
                    waiting.append((rows[0], lists.to_pylist(), rows[1]))
                else:
                    own.append((rows[0], lists.flatten().to_numpy(), rows[1]))
        if found := list(scored()):
            yield out(found)

    pairs = met.mapInArrow(best, "q bigint, rep bigint, score double").groupBy("q", "rep").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = pairs.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1)
    ids = members.join(vectors.select("h", "rep"), "h").select("rep", "ids")
    lists = (
        top.join(ids, "rep").select("q", F.col("score"), F.explode("ids").alias("id"))
        .groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))  # (k + 1) squared at most
        .select(F.col("q").alias("rep"), F.slice("all", 1, k + 1).alias("all"))
    )
    answers = asked.join(lists, "rep").select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k)).alias("n", "x")
    )
    return answers.select("query_id", (F.col("n") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
