"""MinHash near-duplicates by tensored banding.

A table's key combines one key of collection A with one of collection B. Each
collection has ``TABLES`` keys of ``ROWS`` minhashes, so ``TABLES`` squared
tables of ``2 * ROWS`` rows need only ``2 * TABLES * ROWS`` minhashes (108
instead of 1,944). Documents that share a combined key are candidates; links
are confirmed on the full sets of shingles. A pair of similarity 0.75 is missed
with probability 1e-4 (its keys) and 1e-6 (its signatures), a closer one less.

How hot groups are handled, without emitting a group's pairs or cutting any:

1. Documents with equal sets are one representative, the smallest id.
2. Keys of A that one document has alone are left out before they are combined.
3. Each document is compared with the smallest member of its tables that looks
   closest: linear in the group, and it joins the bulk of each group of copies.
4. Documents of tables that still hold several components meet by their keys of
   A, in blocks, and are compared within tasks: first by signature, and those
   with a likely partner on full sets. Only confirmed links leave a task, and of
   these enough to connect the components.

Components come from star contractions on tables of links.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docmill.llm import worker
from docmill.llm.names import fresh
from docmill.session import cut_lineage, session_setting

WORDS, SHARE = 5, 75
TABLES, ROWS = 18, 3
#: Rows that pass between Spark and a worker at once.
ROWS_PER_BATCH = "500"
#: Combined keys that a task makes, and bytes of a stored table that it reads: the
#: rows made of them are many times as large, and are grouped before they move.
KEYS_PER_TASK, BYTES_PER_TASK = 500_000, "4m"
#: Signatures that agree less aren't confirmed: 4.8 standard errors under 0.75.
LIKELY = 0.55
#: Documents compared by signature, and shingles compared in full, in a block.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
_HASHES = 2 * TABLES * ROWS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASKS = np.random.default_rng(5).integers(0, 2**64, _HASHES, np.uint64)
_FACTORS = np.random.default_rng(6).integers(0, 2**64, _HASHES, np.uint64) | np.uint64(1)


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; of fewer words, one."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    run = min(size, len(words))
    out = np.full(len(h) - run + 1, run, np.uint64)
    for i in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - run + 1 + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[k : k + 2048, None] ^ _MASKS) * _FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _features(docs: DataFrame, size: int) -> DataFrame:
    """Id, number of shingles, fingerprint of the set and signature of each row."""
    def run(batches):
        worker.kept("near-duplicates", dict)
        for batch in batches:
            n, prints, signatures = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.list_(pa.int32())),
            ], names=["id", "n", "print", "signature"])

    return docs.mapInArrow(run, "id bigint, n bigint, print binary, signature array<int>")


def _keys(collection: int, *first) -> Column:
    """The keys of a collection: hashes of ``ROWS`` minhashes each, with what goes before."""
    begin = collection * TABLES * ROWS
    return F.array(*[F.xxhash64(*first, F.lit(collection * TABLES + t), F.slice("signature", begin + t * ROWS + 1, ROWS)) for t in range(TABLES)])


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The full sets of documents; of repeated ids, each row's."""
    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"]
            )

    return cut_lineage(docs.join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, set binary"))


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, share: int) -> DataFrame:
    """Those of the pairs (x, y) whose full sets are similar."""
    def similar(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= share * (len(a) + len(b) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = _sets(docs, pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), size)
    joined = pairs.join(own.toDF("x", "a"), "x").join(own.toDF("y", "b"), "y").select("x", "y", "a", "b")
    return cut_lineage(joined.mapInArrow(similar, "x bigint, y bigint"))


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of all ids in links (x, y).

    Large stars and small stars in turn, each a grouped minimum and a join,
    until nothing changes; as many rounds as the logarithm of the size, mostly.
    """
    edges = links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now


def _groups(batches):
    """(key, rows) of neighbouring rows that agree in their first three columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


class _Block:
    """Rows (block, id, component, n, table, signature, set) that share a key of A."""

    def __init__(self, key, rows, share):
        self.inner, self.share = key[1] == key[2], share
        self.block, self.ids, self.parts, self.n = (np.array([r[i] for r in rows]) for i in range(4))
        self.table = rows[0][4]
        self.signatures = np.array([r[5] for r in rows])

    def maybe(self, i: int) -> np.ndarray:
        """Rows that row i is to be compared with: of other components, behind
        it, of like size and signature, with a combined key in common, and with
        no earlier key of A, so that each pair comes up once."""
        after = self.ids > self.ids[i] if self.inner else self.block > self.block[i]
        other = np.flatnonzero(after & (self.parts != self.parts[i]))
        other = other[100 * np.minimum(self.n[other], self.n[i]) >= self.share * np.maximum(self.n[other], self.n[i])]
        same = self.signatures[other] == self.signatures[i]
        tables = same.reshape(len(other), 2, TABLES, ROWS).all(3)
        return other[(same.mean(1) >= LIKELY) & (tables[:, 0].argmax(1) == self.table) & tables[:, 1].any(1)]


def _open_cases(share: int):
    """Key of A and id of documents with a pair to be confirmed there."""
    def run(batches):
        for key, rows in _groups(batches):
            if len(rows) > 1:
                block, found = _Block(key, rows, share), np.zeros(len(rows), bool)
                for i in range(len(rows)):
                    other = block.maybe(i)
                    found[other] = True
                    found[i] |= len(other) > 0
                ids = block.ids[found]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0])), pa.array(ids)], names=["a", "id"])

    return run


def _links_between(share: int):
    """Links between components within blocks, confirmed on full sets; enough to
    connect what belongs together."""
    def run(batches):
        for key, rows in _groups(batches):
            if len(rows) < 2:
                continue
            block, found = _Block(key, rows, share), []
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            for i in range(len(rows)):
                other = block.maybe(i)
                if not len(other):
                    continue
                starts = np.cumsum([0, *[len(sets[o]) for o in other[:-1]]])
                every = np.concatenate([sets[o] for o in other])
                at = np.searchsorted(sets[i], every)
                hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == every
                same = np.add.reduceat(hit.astype(np.int64), starts)
                for o in other[100 * same >= share * (block.n[other] + block.n[i] - same)]:
                    if block.parts[o] != block.parts[i]:
                        found.append((block.ids[i], block.ids[o]))
                        block.parts[block.parts == block.parts[o]] = block.parts[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*found)], names=["x", "y"])

    return run


def _in_blocks(rows: DataFrame, weight: Column, most: int, *columns) -> DataFrame:
    """Rows of a key ``a`` dealt to blocks of about ``most`` in weight, and
    those to tasks by pairs of blocks."""
    blocks = rows.groupBy("a").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return (
        rows.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("a", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", *columns)
        .repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, share: int = SHARE) -> DataFrame:
    """``key``, ``n_shingles`` and ``component`` (smallest key reachable over
    links of similarity ``share`` percent or more) of every row.

    Keys are whole numbers. Rows of one key are one document to the links, and
    stay as many rows. A null key takes no part and has a null component; a
    null or wordless text has no shingles and is its own component.
    """
    spark = docs.sparkSession
    # sets of whole texts: few to a batch
    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH):
        with session_setting(spark, "spark.sql.files.maxPartitionBytes", BYTES_PER_TASK):
            return _near_duplicates(docs, key, text, size, share)


def _combined(unique: DataFrame, own: DataFrame) -> DataFrame:
    """(id, k): the combined keys of documents with their keys ``own`` of A, made in
    tasks of about ``KEYS_PER_TASK``, however many documents a file or partition holds."""
    keys = own.agg(F.sum(F.size("own"))).first()[0] or 0
    tasks = max(keys * TABLES // KEYS_PER_TASK + 1, own.sparkSession.sparkContext.defaultParallelism)
    return (
        unique.select("id", "signature").repartition(tasks, "id").join(own.repartition(tasks, "id"), "id")
        .select("id", "signature", F.explode("own").alias("o")).select("id", "signature", "o.a")
        .select("id", F.explode(_keys(1, F.col("a"))).alias("k"))
    )


def _near_duplicates(docs: DataFrame, key: str, text: str, size: int, share: int) -> DataFrame:
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    features = cut_lineage(_features(docs, size))
    sets = features.where("n > 0 AND id IS NOT NULL")
    unique = cut_lineage(sets.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")))

    # keys of A that several documents have
    a = unique.select("id", F.posexplode(_keys(0)).alias("t", "a"))
    shared = a.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a")
    own = a.join(shared, "a").groupBy("id").agg(F.collect_list(F.struct("t", "a")).alias("own"))  # at most TABLES each
    own = cut_lineage(own)
    combined = _combined(unique, own)
    tables = combined.groupBy("k").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("k", "pivot")
    rows = cut_lineage(combined.join(tables, "k"))

    brief = unique.select("id", "n", "signature")
    agree = F.size(F.filter(F.zip_with("s", "signature", lambda p, q: p == q), lambda same: same)) / F.lit(float(_HASHES))
    closest = (
        rows.where("id <> pivot").select("id", "pivot").distinct()
        .join(brief.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("signature").alias("s")), "pivot").join(brief, "id")
        .where(100 * F.least("n", "m") >= share * F.greatest("n", "m")).withColumn("agree", agree).where(F.col("agree") >= LIKELY)
        .groupBy("id").agg(F.max(F.struct("agree", (-F.col("pivot")).alias("p"))).alias("best"))
        .select((-F.col("best.p")).alias("x"), F.col("id").alias("y"))
    )
    links = _confirmed(docs, cut_lineage(closest), size, share)
    parts = components(links)

    # documents in tables that hold several components
    part = F.coalesce("component", "id")
    with_parts = rows.join(parts, "id", "left").select("id", "k", part.alias("component"))
    mixed = with_parts.groupBy("k").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("k")
    open_ids = cut_lineage(rows.join(mixed, "k", "left_semi").select("id").distinct())
    cases = (
        own.join(open_ids, "id", "left_semi").select("id", F.explode("own").alias("o")).select("id", "o.t", "o.a")
        .join(unique.select("id", "n", "signature"), "id").join(parts, "id", "left").withColumn("component", part)
    )
    columns = ["id", "component", "n", "t", "signature"]
    opened = _in_blocks(cases, F.lit(1), BLOCK, *columns).mapInArrow(_open_cases(share), "a bigint, id bigint").distinct()
    opened = cut_lineage(opened)
    sets = _sets(docs, opened.select("id").distinct(), size)
    full = cases.join(opened, ["a", "id"], "left_semi").join(sets, "id")
    found = _in_blocks(full, F.col("n"), BLOCK_SHINGLES, *columns, "set").mapInArrow(_links_between(share), "x bigint, y bigint")
    links = cut_lineage(links.union(found.select(F.least("x", "y"), F.greatest("x", "y"))).distinct())
    parts = components(links)
    by_set = unique.select("print", "id").join(parts, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    return features.select("id", "n", "print").join(by_set, "print", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those whose component holds a smaller key."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, key, text).where(F.col(f"`{key}`") != F.col("component")).select(F.col(f"`{key}`").alias(name)).distinct()
    return docs.join(cut_lineage(gone), F.col(f"`{key}`") == F.col(name), "left_anti")
