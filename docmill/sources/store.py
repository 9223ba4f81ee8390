"""A vector store on Parquet, as a log of immutable segments: upsert by id,
filtered scans, counts, statistics, reset.

Rows lie in hash buckets of their id. An upsert writes one segment that holds only
its own rows, in the buckets they fall into, and the list of older rows that it
replaces (``dead``), found by the ids of these buckets alone; nothing older is
written again. A read takes every segment without its dead rows, so filters go
down to the scan of each segment. ``compact`` puts the segments of a bucket together.

What a segment holds is also counted when it is written: rows, the range of every
short column, and a small table of group counts, with the replaced rows as negative
counts. So counts and statistics need no scan of the rows, and a filter skips
segments whose range excludes it.

A numbered manifest names the segments. It is created under a name that must not
exist yet, so of two writers one is told, and starts over from the other's manifest.
One that is cut short lacks its last line and doesn't count.
"""
import json
import logging
import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from docmill.operators.chunk import CHUNK_COLUMNS
from docmill.plans.stats import combinations, labelled

log = logging.getLogger("docmill")
VECTOR_COLUMNS = [*CHUNK_COLUMNS, "embedding"]
#: Hash buckets of a new store; times that a write starts over; characters of a range's ends.
BUCKETS, TRIES, PREFIX = 16, 5, 64
_BUCKET, _SEGMENT = "_bucket", "_segment"
_END = "\nend"


def latest_by_id(df: DataFrame, key: str, order: list[Column], *near: str) -> DataFrame:
    """One row per key, the first in ``order``; losers drop before the shuffle, of
    which there is none if the rows lie by ``near`` already."""
    rank = F.row_number().over(Window.partitionBy(*near, key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def upsert(old: DataFrame | None, new: DataFrame, key: str = "chunk_id", order: str = "chunk_idx") -> DataFrame:
    """Rows of ``old`` replaced or extended by ``new``; within ``new`` the first wins."""
    first = latest_by_id(new, key, [F.col(order)])
    if old is None:
        return first
    return old.join(first.select(key), key, "left_anti").unionByName(first)


def batch_number(position, size: int) -> Column:
    return F.floor(position / size)


class Conflict(RuntimeError):
    """Another writer has published the version meanwhile."""


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", order: str = "chunk_idx", buckets: int = BUCKETS):
        """``key``: the id column; of rows of one id in one write, the first by
        ``order`` (if there is such a column) counts. ``buckets`` is for a new store;
        one that exists keeps its own."""
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(e.getPath().getName() for e in self._fs.listStatus(self._path(folder)))

    def _manifests(self) -> list[str]:
        return [n for n in self._names(self.path) if n.startswith("CURRENT-")]

    def _manifest(self, name: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text.removesuffix(_END)) if text.endswith(_END) else None

    def current(self) -> dict | None:
        """The last complete manifest, or None."""
        for name in reversed(self._manifests()):
            found = self._manifest(name)
            if found:
                return found
        return None

    def exists(self) -> bool:
        return self.current() is not None

    def _publish(self, base: dict | None, schema: T.StructType, segments: list[dict], stats: list[str]) -> None:
        number = base["number"] + 1 if base else 1
        state = {"number": number, "buckets": base["buckets"] if base else self.buckets, "schema": schema.json(), "segments": segments, "stats": stats}
        pointer = self._path(f"{self.path}/CURRENT-{number:012d}")
        try:
            stream = self._fs.create(pointer, False)
        except Exception as failure:
            if "FileAlreadyExists" in str(failure) or self._fs.exists(pointer):
                raise Conflict(f"another writer has published version {number} of {self.path}") from failure
            raise
        try:
            stream.write(bytearray((json.dumps(state) + _END).encode()))
        finally:
            stream.close()

    # segments

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _write_segment(self, rows: DataFrame, buckets: int) -> dict:
        """Write rows with ``_bucket`` as a segment; what it holds."""
        name = f"s-{uuid.uuid4().hex}"
        ranged = [f for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)) and f.name not in ("text", _BUCKET)]

        def end(f):
            return F.left(F.col(f"`{f.name}`"), F.lit(PREFIX)) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")

        seen = Observation()
        ends = [agg(end(f)).alias(f"{i}{which}") for i, f in enumerate(ranged) for which, agg in (("a", F.min), ("b", F.max))]
        observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *ends)
        observed.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{_SEGMENT}={name}")
        got = seen.get
        known = {f.name: [got[f"{i}a"], got[f"{i}b"]] for i, f in enumerate(ranged)}
        usable = {n: r for n, r in known.items() if all(isinstance(x, (str, int, bool)) or isinstance(x, float) and math.isfinite(x) or x is None for x in r)}
        held = [int(n.partition("=")[2]) for n in self._names(f"{self.path}/data/{_SEGMENT}={name}") if n.startswith(f"{_BUCKET}=")]
        return {"name": name, "rows": got["rows"], "dead": [], "n_dead": 0, "buckets": sorted(held), "ranges": usable}

    def _spread(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows by bucket, one of each id, sorted so that the files' own ranges are short."""
        rows = rows.withColumn(_BUCKET, self._bucket(buckets)).repartition(buckets, _BUCKET)
        order = [F.col(self.order)] if self.order in rows.columns else [F.lit(1)]
        sort = [c for c in (_BUCKET, "chunk_type", self.key) if c in rows.columns]
        return latest_by_id(rows, self.key, order, _BUCKET).sortWithinPartitions(*sort)

    def _segments(self, state: dict, chosen: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of segments, dead ones too, with ``_segment`` and ``_bucket``."""
        full = T.StructType([*schema.fields, T.StructField(_SEGMENT, T.StringType()), T.StructField(_BUCKET, T.IntegerType())])
        if not chosen:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/data/{_SEGMENT}={s['name']}" for s in chosen]
        df = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)
        kept = {tuple(s["buckets"]) for s in chosen}
        if kept == {tuple(range(state["buckets"]))}:
            return df
        inside = F.lit(False)
        for own in kept:
            names = [s["name"] for s in chosen if tuple(s["buckets"]) == own]
            inside = inside | (F.col(_SEGMENT).isin(names) & F.col(_BUCKET).isin(list(own)))
        return df.where(inside)

    def _live(self, state: dict, chosen: list[dict], where: list[Column] = ()) -> DataFrame:
        """Rows of segments that no later one replaces."""
        schema = T.StructType.fromJson(json.loads(state["schema"]))

        def scan(part):
            df = self._segments(state, part, schema)
            for condition in where:
                df = df.where(condition)
            return df

        clean, hurt = [s for s in chosen if not s["dead"]], [s for s in chosen if s["dead"]]
        if not hurt:
            return scan(clean)
        paths = sorted({f"{self.path}/dead/{d}" for s in hurt for d in s["dead"]})
        dead = self._dead(schema, paths).where(F.col(_SEGMENT).isin([s["name"] for s in hurt]))
        rest = scan(hurt)
        dead = dead.select(F.col(_SEGMENT).alias("_gone_of"), F.col(self.key).alias("_gone"))
        # null ids are one id
        rest = rest.join(dead, (F.col(_SEGMENT) == F.col("_gone_of")) & F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
        return scan(clean).unionByName(rest) if clean else rest

    def _dead(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType([T.StructField(_SEGMENT, T.StringType()), T.StructField(self.key, schema[self.key].dataType)])).parquet(*paths)

    # writes

    def write(self, rows: DataFrame) -> None:
        """Publish ``rows`` as the whole content."""
        self._put(rows, lambda state: None)

    def upsert(self, chunks: DataFrame, replace_documents: bool = False) -> None:
        """Insert or replace by id. Chunks of edited documents stay unless
        ``replace_documents`` drops the documents' older chunks first."""
        columns = [c for c in VECTOR_COLUMNS if c in chunks.columns] if self.key == "chunk_id" else chunks.columns
        self._put(chunks.select(*columns), lambda state: state, replace_documents)

    def _put(self, rows: DataFrame, base, replace_documents: bool = False) -> None:
        written, buckets = None, None
        for attempt in range(TRIES):
            state = self.current()
            over = base(state) if state else None
            if written is None or buckets != (state or {"buckets": self.buckets})["buckets"]:
                buckets = state["buckets"] if state else self.buckets
                written = self._write_segment(self._spread(rows, buckets), buckets)
            segments, stats = self._after(state, over, written, rows.schema, replace_documents)
            fields = T.StructType.fromJson(json.loads(over["schema"])).fields if over else []
            schema = T.StructType([*fields, *[f for f in rows.schema.fields if f.name not in {x.name for x in fields}]])
            try:
                return self._publish(state, schema, segments, stats)
            except Conflict:
                if attempt == TRIES - 1:
                    raise
                log.info("starting over: another writer has changed %s", self.path)

    def _after(self, state: dict | None, over: dict | None, new: dict, schema: T.StructType, replace_documents: bool):
        """Segments and group counts with ``new`` over what ``over`` holds."""
        fresh = self.spark.read.schema(schema).parquet(f"{self.path}/data/{_SEGMENT}={new['name']}") if new["rows"] else self.spark.createDataFrame([], schema)
        counts = combinations(fresh)
        segments, name = [dict(s) for s in over["segments"]] if over else [], f"d-{uuid.uuid4().hex}"
        if segments and new["rows"]:
            touched = [s for s in segments if set(s["buckets"]) & set(new["buckets"])]
            old = self._live(over, touched, [F.col(_BUCKET).isin(new["buckets"])])
            gone = old.join(fresh.select(F.col(self.key).alias("_new")), F.col(self.key).eqNullSafe(F.col("_new")), "left_semi")
            if replace_documents:
                documents = fresh.select("doc_name").distinct()
                gone = gone.unionByName(self._live(over, segments).join(documents, "doc_name", "left_semi")).dropDuplicates([_SEGMENT, self.key])
            groups = [c for c in ("category", "vendor", "chunk_type", "model", "component", "family", "product_family") if c in gone.columns and c != self.key]
            gone = gone.select(_SEGMENT, self.key, *groups)
            gone.write.parquet(f"{self.path}/dead/{name}")
            dead = self.spark.read.schema(gone.schema).parquet(f"{self.path}/dead/{name}")
            lost = {r[0]: r[1] for r in dead.groupBy(_SEGMENT).agg(F.count(F.lit(1))).collect()}  # a row per segment
            for s in segments:
                if s["name"] in lost:
                    s["dead"], s["n_dead"] = [*s["dead"], name], s["n_dead"] + lost[s["name"]]
            counts = counts.unionByName(combinations(dead).withColumn("n", -F.col("n")))
        table = f"n-{uuid.uuid4().hex}"
        counts.coalesce(1).write.parquet(f"{self.path}/stats/{table}")
        if new["rows"]:
            segments.append(new)
        return [s for s in segments if s["n_dead"] < s["rows"]], [*(over["stats"] if over else []), table]

    def compact(self, most: int = 4) -> None:
        """Put the segments of every bucket that lies in more than ``most`` of them
        together, without their dead rows; the group counts become one table."""
        state = self.current()
        if not state:
            return
        wide = [b for b in range(state["buckets"]) if sum(b in s["buckets"] for s in state["segments"]) > most]
        if not wide:
            return
        chosen = [s for s in state["segments"] if set(s["buckets"]) & set(wide)]
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        rows = self._live(state, chosen, [F.col(_BUCKET).isin(wide)]).drop(_SEGMENT)
        rows = rows.repartition(len(wide), _BUCKET).sortWithinPartitions(*[c for c in (_BUCKET, "chunk_type", self.key) if c in schema.names])
        new = self._write_segment(rows, state["buckets"])
        segments = [s for s in state["segments"] if s not in chosen]
        narrow = [s for s in chosen if set(s["buckets"]) - set(wide)]
        if narrow:
            # what is left of these, and how much of it is dead: a row per segment and bucket
            rows_in = self._segments(state, narrow, schema).groupBy(_SEGMENT, _BUCKET).agg(F.count(F.lit(1)).alias("n"))
            paths = sorted({f"{self.path}/dead/{d}" for s in narrow for d in s["dead"]})
            dead_in = self._dead(schema, paths).groupBy(_SEGMENT, self._bucket(state["buckets"]).alias(_BUCKET)).agg(F.count(F.lit(1)).alias("n")).collect() if paths else []
            rows_in, dead_in = ({(r[0], r[1]): r[2] for r in x} for x in (rows_in.collect(), dead_in))
            for s in narrow:
                own = sorted(set(s["buckets"]) - set(wide))
                n, gone = (sum(x.get((s["name"], b), 0) for b in own) for x in (rows_in, dead_in))
                if n > gone:
                    segments.append({**s, "buckets": own, "rows": n, "n_dead": gone, "dead": s["dead"] if gone else []})
        table = f"n-{uuid.uuid4().hex}"
        counts = self._counts(state)
        counts = counts.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n <> 0")
        counts.coalesce(1).write.parquet(f"{self.path}/stats/{table}")
        self._publish(state, schema, [*segments, new] if new["rows"] else segments, [table])

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` manifests don't name. Scans that began under
        an older one fail; those of the kept ones go on."""
        names = self._manifests()
        for name in names[: -max(keep, 1)]:
            self._fs.delete(self._path(f"{self.path}/{name}"), False)
        left = [m for m in map(self._manifest, names[-max(keep, 1) :]) if m]
        used = {f"data/{_SEGMENT}={s['name']}" for m in left for s in m["segments"]}
        used |= {f"dead/{d}" for m in left for s in m["segments"] for d in s["dead"]} | {f"stats/{t}" for m in left for t in m["stats"]}
        for folder in ("data", "dead", "stats"):
            for name in self._names(f"{self.path}/{folder}"):
                if f"{folder}/{name}" not in used:
                    self._fs.delete(self._path(f"{self.path}/{folder}/{name}"), True)

    # reads

    @staticmethod
    def _may_hold(segment: dict, where: dict) -> bool:
        for name, value in where.items():
            low, high = segment["ranges"].get(name, (None, None))
            if name not in segment["ranges"] or value is None:
                continue
            if low is None:
                return False  # only nulls
            if isinstance(value, str) != isinstance(low, str) or isinstance(value, bool) != isinstance(low, bool):
                continue
            # the ends of a text's range are cut, in the order of code points as Spark compares bytes of UTF-8
            value = value[:PREFIX] if isinstance(value, str) else value
            if value < low or value > high:
                return False
        return True

    def segments_for(self, where: dict | None = None) -> list[dict]:
        """Segments that a read with this filter opens."""
        state = self.current()
        return [s for s in state["segments"] if self._may_hold(s, where or {})] if state else []

    def read(self, where: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        """Scan with metadata equality filters and column pruning."""
        state = self.current()
        if not state:
            raise FileNotFoundError(f"no store at {self.path}")
        chosen = [s for s in state["segments"] if self._may_hold(s, where or {})]
        df = self._live(state, chosen, [F.col(f"`{name}`") == value for name, value in (where or {}).items()])
        return df.select(*columns) if columns else df.drop(_SEGMENT, _BUCKET)

    def count(self) -> int:
        """Rows, from the manifest."""
        state = self.current()
        return sum(s["rows"] - s["n_dead"] for s in state["segments"]) if state else 0

    def _counts(self, state: dict) -> DataFrame:
        schema = combinations(self.spark.createDataFrame([], "chunk_type string")).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/stats/{t}" for t in state["stats"]])

    def stats(self) -> DataFrame:
        """(dimension, value, n) as ``collection_stats`` of all rows, from the counts kept."""
        state = self.current()
        if not state:
            raise FileNotFoundError(f"no store at {self.path}")
        return labelled(self._counts(state)).where("n <> 0 OR dimension = 'total'")

    def reset(self) -> None:
        self._fs.delete(self._path(self.path), True)
