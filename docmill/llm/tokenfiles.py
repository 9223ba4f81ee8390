"""Token ids in binary files with a minimal perfect hash index.

A store is a folder:

* ``ids-*.bin``: raw ids (unsigned 16 or 32 bits, little-endian) of documents
  in ascending order of their keys, one shard after the other; behind them the
  offsets (u64, one more than documents), keys (i64), whether a key is there
  (u8), and 24 bytes: documents, ids (u64 each), width, ``IDS1`` (u32 each).
* ``index-*.bin``: for the keys of one hash bucket a minimal perfect hash
  (levels of bit vectors with ranks), and by its number a fingerprint (u32),
  the ordinal of the first document (u64) and how many documents (u64) have
  the key; they follow each other.
* ``manifest``: a Parquet table of the files. A task names its files by chance
  and reports them, and only reported files count, so what a lost or repeated
  task left is never read.

Files are written and read by the tasks with ``pyarrow.fs``, in a folder that
all executors share. Keys are dealt by range with the text's hash behind the
key, so that a key of many rows is spread over shards.
"""
import json
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import worker

#: Keys per index bucket, about.
BUCKET_KEYS = 100_000
#: Words that a worker remembers the ids of, per generation (of two).
REMEMBERED = 400_000
#: Texts that are coded together.
TOGETHER = 256
_MAGIC = 0x31534449


def _mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the splitmix64 finaliser)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys, 77) % np.uint64(buckets)).astype(np.int32)


class PerfectHash:
    """Numbers distinct keys from 0 without gaps. Level by level, keys that
    have a bit of the level to themselves stop there; a key's number is the
    count of set bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # unpacked bits
        self.bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        self.starts = np.cumsum([0, *map(len, levels)])
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        levels = []
        while len(keys):
            size = max(64, int(1.5 * len(keys)))
            at = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once.astype(np.uint8))
            keys = keys[~once[at]]
        return PerfectHash(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that reach no level's set bit; other unknown keys get
        some number, which their fingerprint gives away."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for d, level in enumerate(self.levels):
            at = (_mixed(keys[left], d) % np.uint64(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[left[hit]] = self.rank[self.starts[d] + at[hit]]
            left = left[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


def _index_bytes(keys, first, copies) -> bytes:
    order = np.lexsort((first, keys))
    keys, first, copies = keys[order], first[order], copies[order]
    distinct, at = np.unique(keys, return_index=True)
    copies = np.add.reduceat(copies, at)  # a key's shards follow each other
    hashed = PerfectHash.build(distinct)
    place = hashed.numbers(distinct)
    table = np.zeros(len(distinct), [("print", "<u4"), ("first", "<u8"), ("copies", "<u8")])
    table["print"][place], table["first"][place], table["copies"][place] = _fingerprints(distinct), first[at], copies
    sizes = np.array([len(distinct), len(hashed.levels), *map(len, hashed.levels)], "<u8")
    return sizes.tobytes() + np.packbits(hashed.bits).tobytes() + table.tobytes()


class Index:
    """One bucket's index, read from its bytes."""

    def __init__(self, data: bytes):
        n, levels = map(int, np.frombuffer(data, "<u8", 2))
        sizes = np.frombuffer(data, "<u8", levels, 16).astype(np.int64)
        at, bits = 16 + 8 * levels, int(sizes.sum())
        packed = np.frombuffer(data, np.uint8, (bits + 7) // 8, at)
        unpacked = np.unpackbits(packed, count=bits) if bits else np.zeros(0, np.uint8)
        self.hash = PerfectHash(np.split(unpacked, np.cumsum(sizes)[:-1]) if levels else [])
        self.table = np.frombuffer(data, [("print", "<u4"), ("first", "<u8"), ("copies", "<u8")], n, at + len(packed))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinal of the first document and number of documents of each key; 0 documents if unknown."""
        place = self.hash.numbers(keys)
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        row = self.table[np.maximum(place, 0)]
        known = (place >= 0) & (row["print"] == _fingerprints(keys))
        return row["first"].astype(np.int64), np.where(known, row["copies"].astype(np.int64), 0)


class Coder:
    """Ids of texts from a file of the tokenizers library.

    ``by_word``: the tokenizer ignores case, drops white space and looks at each
    word between spaces, and at each run of signs, for itself; so words' ids can
    be remembered.
    """

    def __init__(self, path: str, end_id: int, width: int, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype(f"<u{width}")
        self.end = np.array([end_id], self.type).tobytes()
        self.by_word, self.known, self.older = by_word, {}, {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") if by_word else None
        names = self.tokenizer.get_vocab()
        #: tokens that end a word
        self.ends = np.array([n.endswith(suffix) for n in sorted(names, key=names.get)]) if suffix and sorted(names.values()) == list(range(len(names))) else None

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters alone: coded as one text, and cut behind the
        tokens that end a word, where the tokenizer has such tokens."""
        if self.ends is None or not words:
            return self._coded([w.decode() for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._coded([w.decode() for w in words])
        coded, size = ids.astype(self.type).tobytes(), self.type.itemsize
        return [coded[size * a : size * b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]

    def _learn(self, words: set[bytes]) -> None:
        """Remember the ids of words; those of a word with signs behind it are put together."""
        known, older, signed, plain, other = self.known, self.older, [], set(), set()
        for w in words:
            if (found := older.get(w)) is not None:
                known[w] = found
                continue
            core = w.rstrip(b".,!?;:")
            if core is not w and len(core) < len(w) and core[-1:].isalpha():
                signed.append((w, core, w[len(core) :]))
            for x in (core, w[len(core) :]) if signed and signed[-1][0] is w else (w,):
                if x not in known:
                    (plain if x.decode().isalpha() else other).add(x)
        for kind, code in ((plain, self._plain), (other, lambda part: self._coded([w.decode() for w in part]))):
            for w in [w for w in kind if w in older]:
                known[w] = older[w]
                kind.remove(w)
            kind = list(kind)
            for k in range(0, len(kind), 5000):
                known.update(zip(kind[k : k + 5000], code(kind[k : k + 5000])))
        for w, core, tail in signed:
            known[w] = known[core] + known[tail]

    @worker.acyclic
    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [x + self.end for t in texts for x in self._coded([t])]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        # the form of special tokens, which keep their case
        split = [(d if b"<|" in d else d.lower()).split() for d in (t.encode() for t in texts)]
        known = self.known
        self._learn(set(chain.from_iterable(split)).difference(known))
        return [b"".join([*map(known.__getitem__, words), self.end]) for words in split]


def _coder(*args) -> Coder:
    return worker.kept(("ids", *args), lambda: Coder(*args))


def _open(folder: str):
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
          width: int = 2, by_word: bool = True) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write a store.

    ``tokenizer`` is a path that all executors can read. Rows of one key stay
    apart, in the order of their texts' hashes; null keys come first and are
    read by a scan only. ``width`` is 2 or 4 bytes an id.
    """
    spark = docs.sparkSession
    shared = f"{folder.rstrip('/')}"
    if "://" not in shared and ":/" not in shared:
        shared = "file://" + shared
    _open(shared)[0].create_dir(_open(shared)[1], recursive=True)

    def shard(batches):
        coder = _coder(tokenizer, end_id, width, by_word)
        system, path = _open(shared)
        name = f"ids-{uuid.uuid4().hex}.bin"
        out, sizes, keys, there = None, [0], [], []
        lowest = None
        for batch in batches:
            if batch.num_rows and out is None:
                out = system.open_output_stream(f"{path}/{name}")
                lowest = batch.slice(0, 1)
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                for data in coder.encode([t.as_py() or "" for t in part.column(1)]):
                    out.write(data)
                    sizes.append(len(data) // width)
            keys.append(batch.column(0).fill_null(0).to_numpy())
            there.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        offsets = np.cumsum(sizes, dtype=np.uint64)
        for data in (offsets.astype("<u8"), np.concatenate(keys).astype("<i8"), np.concatenate(there)):
            out.write(data.tobytes())
        out.write(np.array([len(sizes) - 1, offsets[-1]], "<u8").tobytes() + np.array([width, _MAGIC], "<u4").tobytes())
        out.close()
        yield pa.RecordBatch.from_arrays([
            pa.array(["ids"]), pa.array([name]), lowest.column(0), lowest.column(2), pa.array([len(sizes) - 1]), pa.array([int(offsets[-1])]), pa.array([0], pa.int32()),
        ], names=["kind", "name", "low", "low_hash", "docs", "ids", "bucket"])

    schema = "kind string, name string, low bigint, low_hash bigint, docs bigint, ids bigint, bucket int"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    shards = rows.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash").mapInArrow(shard, schema)
    shards.write.parquet(f"{folder}/manifest/part=ids")
    store = TokenStore(spark, folder)
    buckets = max(1, -(-int(store.base_docs[-1]) // BUCKET_KEYS))

    def entries(batches):
        for name, ordinal in _names(batches):
            _, keys, there = store.footer(name)[1:4]
            own = np.flatnonzero(there)
            if len(own):
                starts = np.flatnonzero(np.diff(keys[own], prepend=keys[own][0] - 1))
                distinct = keys[own][starts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(_bucket(distinct, buckets)), pa.array(distinct), pa.array(own[starts] + ordinal),
                    pa.array(np.diff(starts, append=len(own))),
                ], names=["bucket", "key", "first", "copies"])

    def index(batches):
        system, path = _open(shared)

        def put(bucket, parts):
            name = f"index-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(_index_bytes(*[np.concatenate(c) for c in zip(*parts)]))
            return pa.RecordBatch.from_arrays(
                [pa.array(["index"]), pa.array([name]), pa.array([bucket], pa.int32())], names=["kind", "name", "bucket"]
            )

        at, parts = None, []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
                if b > a:
                    if at is not None and bucket[a] != at:
                        yield put(at, parts)
                        parts = []
                    at = int(bucket[a])
                    parts.append([c.slice(a, b - a).to_numpy() for c in batch.columns[1:]])
        if parts:
            yield put(at, parts)

    listed = store.shards().mapInArrow(entries, "bucket int, key bigint, first bigint, copies bigint")
    dealt = listed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(index, "kind string, name string, bucket int").write.parquet(f"{folder}/manifest/part=index")


def _names(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


class TokenStore:
    """Reads a store. The driver holds one short row per shard (64 MB and more) and bucket."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        if "://" not in self.folder and ":/" not in self.folder:
            self.folder = "file://" + self.folder
        rows = spark.read.parquet(f"{folder}/manifest/part=ids").orderBy(
            F.col("low").asc_nulls_first(), F.col("low_hash").asc_nulls_first()
        ).select("name", "docs", "ids").collect()
        self.names = [r[0] for r in rows]
        self.base_docs = np.cumsum([0, *[r[1] for r in rows]])
        self.base_ids = np.cumsum([0, *[r[2] for r in rows]])
        self._spark = spark

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_spark"}

    def index_files(self) -> dict[int, str]:
        rows = self._spark.read.parquet(f"{self.folder}/manifest/part=index").select("bucket", "name").collect()
        return {r[0]: r[1] for r in rows}

    def shards(self) -> DataFrame:
        """``name`` and ordinal of the first document of every shard, a task each."""
        rows = list(zip(self.names, self.base_docs.tolist()))
        return self._spark.createDataFrame(rows, "name string, ordinal bigint").repartition(max(1, len(rows)))

    def footer(self, name: str):
        """Open file, offsets, keys, whether there is a key, and the type of the ids."""
        system, path = _open(self.folder)
        file = system.open_input_file(f"{path}/{name}")
        size = file.size()
        end = file.read_at(24, size - 24)
        docs = int(np.frombuffer(end, "<u8", 1)[0])
        width, magic = np.frombuffer(end, "<u4", 2, 16)
        if magic != _MAGIC:
            raise ValueError(f"{name} is no file of ids")
        begin = size - 24 - 17 * docs - 8
        tail = file.read_at(size - 24 - begin, begin)
        return (
            file, np.frombuffer(tail, "<u8", docs + 1).astype(np.int64), np.frombuffer(tail, "<i8", docs, 8 * docs + 8),
            np.frombuffer(tail, np.uint8, docs, 16 * docs + 8), np.dtype(f"<u{width}"),
        )

    def documents(self) -> DataFrame:
        """``key``, ``ordinal``, ``start`` (ids before it), ``n_ids`` and
        ``crc32`` (of the ids as 32 bits) of all documents, by a scan."""
        store, base = self, dict(zip(self.names, self.base_ids.tolist()))

        def run(batches):
            for name, ordinal in _names(batches):
                file, offsets, keys, there, kind = store.footer(name)
                for k in range(0, len(keys), 256):
                    own = offsets[k : k + 257]
                    ids = np.frombuffer(file.read_at(int(own[-1] - own[0]) * kind.itemsize, int(own[0]) * kind.itemsize), kind).astype("<u4")
                    crc = [zlib.crc32(ids[a - own[0] : b - own[0]].tobytes()) for a, b in zip(own[:-1], own[1:])]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[k : k + n], mask=there[k : k + n] == 0), pa.array(np.arange(k, k + n) + ordinal),
                        pa.array(own[:-1] + base[name]), pa.array(np.diff(own)), pa.array(crc, pa.int64()),
                    ], names=["key", "ordinal", "start", "n_ids", "crc32"])

        return self.shards().mapInArrow(run, "key bigint, ordinal bigint, start bigint, n_ids bigint, crc32 bigint")

    def found(self, df: DataFrame, key: str = "key") -> DataFrame:
        """``df`` with ``first`` (ordinal) and ``copies`` of each key, through
        the index; 0 copies for keys not in the store and null keys. Rows are
        dealt by bucket, several tasks a bucket, so a hot key is spread."""
        files, store, where, own = self.index_files(), self, df.columns.index(key), df.columns
        buckets = max(1, -(-int(self.base_docs[-1]) // BUCKET_KEYS))

        def number(batches):
            for batch in batches:
                keys = batch.column(where).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_bucket(keys, buckets))], names=[*batch.schema.names, "_bucket"])

        def look(batches):
            system, path = _open(store.folder)
            at, index = None, None
            for batch in batches:
                keys, bucket = batch.column(where).fill_null(0).to_numpy(), batch.column(len(own)).to_numpy()
                first, copies = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                for b in np.unique(bucket):
                    if b != at:
                        at = b
                        index = Index(system.open_input_file(f"{path}/{files[int(b)]}").read()) if int(b) in files else None
                    if index is not None:
                        rows = np.flatnonzero(bucket == b)
                        first[rows], copies[rows] = index.find(keys[rows])
                copies[~batch.column(where).is_valid().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first), pa.array(copies)], names=[*own, "first", "copies"])

        numbered = df.mapInArrow(number, df.withColumn("_bucket", F.lit(0)).schema)
        dealt = numbered.repartition("_bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8))).sortWithinPartitions("_bucket")
        out = df.withColumn("first", F.lit(0).cast("long")).withColumn("copies", F.lit(0).cast("long"))
        return dealt.mapInArrow(look, out.schema)

    def get(self, key: int, files: dict[int, str] | None = None) -> list[np.ndarray]:
        """The ids of each document of a key, in constant time."""
        files = files or self.index_files()
        keys = np.array([key], np.int64)
        bucket = int(_bucket(keys, max(1, -(-int(self.base_docs[-1]) // BUCKET_KEYS)))[0])
        if bucket not in files:
            return []
        system, path = _open(self.folder)
        first, copies = Index(system.open_input_file(f"{path}/{files[bucket]}").read()).find(keys)
        out = []
        for ordinal in range(int(first[0]), int(first[0] + copies[0])):
            shard = int(np.searchsorted(self.base_docs, ordinal, "right")) - 1
            file, offsets, keys_there, _, kind = self.footer(self.names[shard])
            at = ordinal - int(self.base_docs[shard])
            if keys_there[at] == key:  # a fingerprint may fit by chance
                out.append(np.frombuffer(file.read_at(int(offsets[at + 1] - offsets[at]) * kind.itemsize, int(offsets[at]) * kind.itemsize), kind))
        return out
