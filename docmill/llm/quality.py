"""Quality classifier: random-indexing word vectors, pooled per document, in a
two-layer network with temperature-calibrated probabilities.

* Every whitespace-separated token has a word (lower case, without outer signs,
  hashed to one of ``WORDS`` rows) and a shape (letter case, signs, digits,
  length; ``SHAPES`` rows). Each row has a fixed sparse random index vector.
* A row's context vector is the sum of the index vectors of the words up to two
  tokens away and of the shapes around it, over all documents. Each task adds
  up a matrix of ``WORDS + SHAPES`` rows, and Spark sums these integers, so
  the result doesn't depend on the order.
* A document is the mean of its tokens' word vectors beside the mean of its
  shape vectors and its length.
* The network (numpy: one hidden layer, one output) learns from at most
  ``MOST_LABELS`` labelled rows, those with the smallest hash; a fifth of them
  only sets the temperature. Scoring is a narrow pass with model and vectors,
  of fixed size, broadcast.
"""
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm import worker
from docmill.session import cut_lineage

WORDS, SHAPES, SIZE = 8192, 256, 32
#: Labelled rows that the network learns from, at most.
MOST_LABELS = 20_000
#: Texts that go back from a worker at once.
ROWS_TOGETHER = 512
#: Tokens that a worker remembers the rows of.
REMEMBERED = 200_000
_ROWS = WORDS + SHAPES


class _Rows(dict):
    """Token -> word row * SHAPES + shape."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        core = token.strip("\"'.,;:!?()[]{}*|#$%&-_/\\<>=+~^`@«»")
        at = token.find(core) if core else 0
        tail = token[at + len(core) :] if core else token
        case = 0 if not core.isalpha() else 1 if core.islower() else 2 if core[1:].islower() or len(core) == 1 else 3 if core.isupper() else 4
        signs = 0 if not tail else 1 if tail in ",;:" else 2 if tail in ".!?" else 3 if len(tail) == 1 else 4 if len(set(tail)) == 1 else 5
        long = 0 if len(core) < 4 else 1 if len(core) < 13 else 2 if len(core) < 25 else 3
        shape = ((case * 6 + signs) * 4 + long) * 2 + (at > 0)
        row = self[token] = (zlib.crc32(core.lower().encode("utf-8", "replace")) % WORDS) * SHAPES + shape
        return row


def _rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    tokens = (text or "").split()
    codes = np.fromiter(map(worker.kept("quality", _Rows).__getitem__, tokens), np.int64, len(tokens))
    return codes // SHAPES, WORDS + codes % SHAPES


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions and signs for each row."""
    random = np.random.default_rng(1)
    places = random.integers(0, SIZE, (2, _ROWS))
    places[1] = np.where(places[1] == places[0], (places[0] + 1) % SIZE, places[1])
    return places, random.choice([-1.0, 1.0], (2, _ROWS))


def context_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``n`` (tokens) and ``v0`` ... of every word and shape row, from all documents."""
    names = ["row", "n", *[f"v{i}" for i in range(SIZE)]]

    def add_up(batches):
        places, signs = _index_vectors()
        total = np.zeros(_ROWS * SIZE)
        counts = np.zeros(_ROWS, np.int64)

        def add(rows, near):
            for place, sign in zip(places, signs):
                np.add(total, np.bincount(rows * SIZE + place[near], sign[near], _ROWS * SIZE), out=total)

        for batch in batches:
            words, shapes, size = [], [], 0
            for i, value in enumerate(batch.column(0)):
                w, s = _rows(value.as_py())
                # -1 between documents: pairs with it are left out
                words += [w, [-1, -1]]
                shapes += [s, [-1, -1]]
                size += len(w)
                if size < 400_000 and i < batch.num_rows - 1:
                    continue
                w, s = np.concatenate(words).astype(np.int64), np.concatenate(shapes).astype(np.int64)
                own = w >= 0
                counts += np.bincount(w[own], minlength=_ROWS) + np.bincount(s[own], minlength=_ROWS)
                pairs = [(w[:-k], w[k:]) for k in (1, 2)] + [(s[:-1], s[1:])]
                pairs = [p for a, b in pairs for p in ((a, b), (b, a))] + [(w, s), (s, w)]
                for a, b in pairs:
                    both = (a >= 0) & (b >= 0)
                    add(a[both], b[both])
                words, shapes, size = [], [], 0
        rows = np.flatnonzero(counts)
        sums = total.reshape(_ROWS, SIZE)[rows].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts[rows]), *map(pa.array, sums.T.copy())], names=names)

    schema = ", ".join(f"{n} bigint" for n in names)
    return docs.select(text).mapInArrow(add_up, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]])


@dataclass
class Classifier:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        x = np.clip((pooled - self.mean) / self.scale, -8, 8)
        logit = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, log of the length; zeros without tokens."""
    out = np.zeros(2 * SIZE + 1)
    w, s = _rows(text)
    if len(w):
        for k in range(0, len(w), 100_000):
            out[:SIZE] += vectors[w[k : k + 100_000]].sum(0)
        out[SIZE:-1] = np.bincount(s - WORDS, minlength=SHAPES) @ vectors[WORDS:]
        out[:-1] /= len(w)
        out[-1] = np.log1p(len(w))
    return out


def _pool(docs: DataFrame, vectors: np.ndarray, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = np.array([pooled(t.as_py(), shared.value) for t in batch.column(0)]).reshape(-1, 2 * SIZE + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], names=["pooled", *keep])

    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    return docs.select(text, *keep).mapInArrow(run, f"pooled array<double>, {fields}")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
          most: int = MOST_LABELS) -> Classifier:
    """A classifier for ``labels`` (key, label of 0 or 1) of documents.

    Labels with a null key or another value are left out; of a key with several rows or
    labels each counts, up to ``most`` in all; without any usable
    label the classifier gives every text the share of 1s it saw, or 1/2.
    """
    spark = docs.sparkSession
    table = np.zeros((_ROWS, SIZE))
    for row in cut_lineage(context_vectors(docs, text)).toLocalIterator():  # at most WORDS + SHAPES rows
        table[row[0]] = np.array(row[2:]) / row[1]
    used = table.any(1)
    if used.any():
        table[used] -= table[used].mean(0)
        table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True).clip(1e-9)
    # at most ``most`` rows: broadcast in place of moving texts
    chosen = (
        labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("of"), F.col(f"`{label}`").cast("int").alias("label"))
        .orderBy(F.xxhash64("of"), "of", "label").limit(most)
    )
    chosen = cut_lineage(chosen)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("key") == F.col("of")).select("text", "of", "label")
    # a key of very many rows gives no more than ``most`` of them to the driver
    pooled_rows = _pool(sample, table, "text", ["of", "label"]).orderBy(F.xxhash64("of"), "of", "label", "pooled").limit(most)
    got = sorted((tuple(r) for r in pooled_rows.collect()), key=lambda r: (str(r[1]), r[2], r[0]))
    x = np.array([r[0] for r in got]).reshape(-1, 2 * SIZE + 1)
    y = np.array([r[2] for r in got], float)
    return fit(table, x, y)


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 7) -> Classifier:
    """The network by Adam in mini batches, then the temperature on a fifth of the rows."""
    random = np.random.default_rng(seed)
    n = x.shape[1]
    share = y.mean() if len(y) else 0.5
    model = Classifier(
        vectors, x.mean(0) if len(x) else np.zeros(n), (x.std(0) + 1e-6) if len(x) else np.ones(n),
        random.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), np.zeros(hidden),
        float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1.0,
    )
    if len(y) < 20 or share in (0, 1):
        return model
    x = np.clip((x - model.mean) / model.scale, -8, 8)
    held = random.permutation(len(y)) % 5 == 0
    xs, ys = x[~held], y[~held]
    weights = [model.w1, model.b1, random.normal(0, hidden**-0.5, hidden), np.array(model.b2)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = random.permutation(len(ys))
        for k in range(0, len(order), 128):
            xb, yb = xs[order[k : k + 128]], ys[order[k : k + 128]]
            h = np.tanh(xb @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - yb) / len(yb)
            back = np.outer(error, weights[2]) * (1 - h * h)
            slopes = [xb.T @ back + 1e-4 * weights[0], back.sum(0), h.T @ error + 1e-4 * weights[2], np.array(error.sum())]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.004 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = weights[0], weights[1], weights[2], float(weights[3])
    logit = np.tanh(x[held] @ model.w1 + model.b1) @ model.w2 + model.b2

    def loss(t):
        return np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t).mean()

    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def score(docs: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text (null: empty)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() != name.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in (whole.slice(k, ROWS_TOGETHER) for whole in batches for k in range(0, whole.num_rows, ROWS_TOGETHER)):
            x = np.array([pooled(t.as_py(), m.vectors) for t in batch.column(where)]).reshape(-1, 2 * SIZE + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probabilities(x))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)
