"""Secrets in texts: plain patterns, and a linear-chain conditional random field.

The plain patterns (``base`` spans) are sought in the text as it is. Beyond them
the field tags tokens as outside, begin or inside of a secret. Its features are
the token's shape (length, letter cases, digits, how mixed they are), the words
around it and the signs between them, and what the file looks like. It is trained
here: the tokens of the plain finds are its labels, so it learns how secrets look
and where they stand, and finds those that no pattern names. Values drawn from other
alphabets in the same places are learnt as well (``variants``). The training is on
at most ``MOST_RUNS`` distinct runs of tokens with a secret and as many without,
those of the smallest hash over all texts.

A token can only belong to a secret if it is long enough and mixes letters with
digits or cases; all others are outside. So a text falls into runs of such
tokens, which the field decodes one by one (Viterbi), all runs of a length at
once. Tokens are found in numpy, on the bytes of many texts; texts are
independent, so this is a narrow step with a model of fixed size broadcast.

Null texts count as empty. Repeated rows all stay. Without any plain find there
is nothing to learn from and ``spans`` equals ``base``.
"""
import re
import zlib
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "secret")
#: Runs of tokens with, and without, a secret that the field learns from; longer runs are cut in training.
MOST_RUNS, LONGEST_RUN = 5000, 64
#: Rows of the table of weights, features of a token, bytes looked at together.
ROWS, FEATURES, PORTION = 1 << 14, 20, 1 << 21
OUTSIDE, BEGIN, INSIDE = range(3)
# The patterns of the plain finds.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_TOKEN, LEAST_LONG = 6, 6, 20
# What names of secrets hold.
_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "sign", "clave", "kennwort", "schl", "mdp", "contras", "jeton")
_LOWER, _UPPER, _DIGIT, _SIGN, _ABOVE = range(1, 6)
_CLASS = np.array([
    _LOWER if 97 <= c <= 122 else _UPPER if 65 <= c <= 90 else _DIGIT if 48 <= c <= 57 else _SIGN if c in b"_+/-.~@%" else _ABOVE if c >= 128 else 0
    for c in range(256)
], np.uint8)


def _crc(*parts) -> int:
    return zlib.crc32("\0".join(map(str, parts)).encode("utf-8", "replace")) % ROWS


def _bits(x: float) -> int:
    return int(x).bit_length()


@dataclass
class Portion:
    """Tokens of some texts, and those of them that may belong to a secret."""

    data: bytes
    texts: list[bytes]
    at: np.ndarray  # where each text begins in data
    starts: np.ndarray
    ends: np.ndarray
    own: np.ndarray  # text of each token
    possible: np.ndarray  # tokens

    @classmethod
    def of(cls, texts: list[bytes]) -> "Portion":
        data = b"\n".join(texts)
        at = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        kinds = _CLASS[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (kinds > 0).astype(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts

        def count(kind):
            sums = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
            return sums[ends] - sums[starts]

        digits, upper, lower = count(_DIGIT), count(_UPPER), count(_LOWER)
        possible = (size >= LEAST_TOKEN) & ((digits > 0) & (upper + lower > 0) | (upper > 1) & (lower > 1))
        return cls(data, texts, at, starts, ends, np.searchsorted(at, starts, "right") - 1, np.flatnonzero(possible))

    def word(self, i: int, text: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]] if 0 <= i < len(self.starts) and self.own[i] == text else b""

    def runs(self) -> list[np.ndarray]:
        """Possible tokens that follow one another in a text."""
        p = self.possible
        cuts = np.flatnonzero((np.diff(p) > 1) | (self.own[p[1:]] != self.own[p[:-1]])) + 1
        return [r for r in np.split(p, cuts) if len(r)]

    def files(self) -> dict[int, tuple]:
        """What the texts with possible tokens look like as files."""
        tokens = np.bincount(self.own, minlength=len(self.texts))
        dense = np.bincount(self.own[self.possible], minlength=len(self.texts))
        out = {}
        for t in np.flatnonzero(dense):
            text = self.texts[t]
            out[int(t)] = (
                _bits(64 * dense[t] / max(tokens[t], 1)), _bits(1024 * (text.count(b"=") + text.count(b"{")) / len(text)), _bits(len(text) / (text.count(b"\n") + 1))
            )
        return out

    def sight(self, i: int, file: tuple) -> tuple:
        """What the features of a token are made of."""
        text = int(self.own[i])
        word = self.word(i, text).strip(b".-/~").decode("utf-8", "replace")
        before, older, after = (self.word(i + k, text).decode("utf-8", "replace").lower() for k in (-1, -2, 1))
        left = self.data[self.ends[i - 1] if before else max(self.starts[i] - 3, 0) : self.starts[i]].strip()[-3:].decode("utf-8", "replace")
        right = self.data[self.ends[i] : self.ends[i] + 3].strip()[:1].decode("latin-1")
        return word, before, older, after, left, right, file


def features(sight: tuple) -> list[int]:
    """Rows of the table of weights for a token: shape, neighbours, file."""
    word, before, older, after, left, right, file = sight
    size = len(word)
    digits, upper, lower = sum(c.isdigit() for c in word), sum(c.isupper() for c in word), sum(c.islower() for c in word)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c if c in "@.-_/+" else "s" for c in word)
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    mix = (digits > 0, upper > 0, lower > 0, digits + upper + lower < size)
    stem = next((s for s in _STEMS if s in before), next((s for s in _STEMS if s in older), ""))
    return [
        _crc("bias"), _crc("size", _bits(size), mix), _crc("mix", mix), _crc("digits", 8 * digits // max(size, 1), _bits(size)), _crc("turns", 8 * turns // max(size, 1), mix),
        _crc("kinds", 8 * len(set(word)) // max(size, 1), _bits(size)), _crc("shape", re.sub(r"(.)\1+", r"\1", kinds)[:8]), _crc("lead", word[:4] if upper == size else kinds[:4]),
        _crc("hex", not re.search("[^0-9a-fA-F]", word), _bits(size)), _crc("at", "@" in word, word.count("."), "/" in word),
        _crc("before", before), _crc("older", older), _crc("after", after), _crc("named", bool(stem), left), _crc("stem", stem), _crc("named", bool(stem), _bits(size)), _crc("right", right),
        _crc("dense", file[0]), _crc("marks", file[1]), _crc("wide", file[2]),
    ]


_DRAWN = ("0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/")


def variants(sight: tuple, seed: int) -> list[tuple[tuple, int]]:
    """More to learn from, made of a plain find: other values in its place, behind its
    name and behind another, are secrets; short ones behind no name are not. So the
    field doesn't only learn the alphabets that the patterns name."""
    random = Random(seed)
    word, before, older, after, left, right, file = sight

    def value(low, high):
        made = "".join(random.choices(random.choice(_DRAWN), k=random.randint(low, high)))
        return made if any(c.isdigit() for c in made) else made + str(random.randint(0, 9))

    signs = random.choice(("=", ":", '="', "='", ": '", ":"))
    named = any(s in before or s in older for s in _STEMS)
    out = [((value(10, 48), random.choice(_STEMS), older, after, signs, right, file), BEGIN), ((value(6, 14), after, "", older, "", "", file), OUTSIDE)]
    if named:
        out.append(((value(8, 48), before, older, after, left, right, file), BEGIN))
    return out


def plain(text: bytes, long: list[tuple[int, bytes]]) -> dict[str, list[tuple[int, int, int]]]:
    """Plain finds by kind as (start, end, start of the value) in bytes, leftmost and
    without overlap; those that fail their length are dropped and not tried again otherwise.

    ``long``: the text's tokens of ``LEAST_LONG`` bytes or more with their places,
    since all of an access or hex find lies in one.
    """
    out: dict[str, list] = {k: [] for k in KINDS}
    low = text.lower()
    if any(k in low for k in _KEYS):
        out["assign"] = [(m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for at, token in long:
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            out[kind] += [(at + m.start(), at + m.end(), at + m.start()) for m in pattern.finditer(token)]
    return out


def _plain_of(p: Portion) -> list[dict]:
    """Plain finds of every text."""
    long: dict[int, list] = {}
    for i in np.flatnonzero(p.ends - p.starts >= LEAST_LONG):
        t = int(p.own[i])
        long.setdefault(t, []).append((int(p.starts[i] - p.at[t]), p.data[p.starts[i] : p.ends[i]]))
    return [plain(x, long.get(t, [])) for t, x in enumerate(p.texts)]


def _in_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in bytes as spans in code points."""
    if not spans or text.isascii():
        return spans
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    # the point of a byte is the number of those that begin before it
    at = lambda b: int(points[b - 1]) if b else 0
    return [(k, at(a), at(b)) for k, a, b in spans]


def _portions(texts):
    """Texts in portions of about ``PORTION`` bytes, whole."""
    held, size = [], 0
    for value in texts.cast(pa.binary()):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _place(p: Portion, i: int) -> tuple[int, int, int]:
    """Text of a token, and its span there in bytes, without outer signs."""
    t = int(p.own[i])
    word = p.data[p.starts[i] : p.ends[i]]
    a = int(p.starts[i] - p.at[t]) + len(word) - len(word.lstrip(b".-/~"))
    b = int(p.ends[i] - p.at[t]) - (len(word) - len(word.rstrip(b".-/~")))
    return t, a, max(a, b)


def labelled_runs(docs: DataFrame, text: str = "text", most: int = MOST_RUNS) -> DataFrame:
    """``hash``, ``secret``, ``rows`` (features of all tokens), ``tags`` of distinct
    runs: at most ``most`` with a secret and as many without, by the smallest hash."""

    def run(batches):
        held: dict[bool, dict] = {True: {}, False: {}}
        for batch in batches:
            for texts in _portions(batch.column(0)):
                p = Portion.of(texts)
                if not len(p.possible):
                    continue
                files, found = p.files(), _plain_of(p)
                for r in p.runs():
                    spans = [(v, b) for k in found[int(p.own[r[0]])].values() for _, b, v in k]
                    tags, last = [], None
                    for i in r[:LONGEST_RUN]:
                        _, a, b = _place(p, i)
                        own = next((s for s in spans if a < s[1] and s[0] < b), None)
                        tags.append(OUTSIDE if own is None else INSIDE if own == last else BEGIN)
                        last = own
                    seen = [p.sight(i, files[int(p.own[i])]) for i in r[:LONGEST_RUN]]
                    key = keep(held, seen, tags)
                    for made, tag in variants(seen[0], key) if tags == [BEGIN] else []:
                        keep(held, [made], [tag])
                for kind, kept in held.items():
                    if len(kept) > 2 * most:
                        held[kind] = {k: kept[k] for k in sorted(kept)[:most]}
        for kind, kept in held.items():
            keys = sorted(kept)[:most]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([kind] * len(keys), pa.bool_()),
                pa.array([kept[k][0] for k in keys], pa.list_(pa.int32())), pa.array([kept[k][1] for k in keys], pa.list_(pa.int32())),
            ], names=["hash", "secret", "rows", "tags"])

    def keep(held, seen, tags):
        rows = [x for s in seen for x in features(s)]
        key = (zlib.crc32(np.array(rows + tags, "<i4").tobytes()) << 32 | zlib.crc32(np.array(tags + rows, "<i4").tobytes())) >> 1
        held[any(tags)][key] = (rows, tags)
        return key

    runs = docs.select(text).mapInArrow(run, "hash long, secret boolean, rows array<int>, tags array<int>").distinct()
    first = lambda kind: runs.where("secret" if kind else "NOT secret").orderBy("hash", "rows", "tags").limit(most)
    return first(True).unionByName(first(False))


@dataclass
class Field:
    """Weights of features by tag, and of a tag after another; outside before and behind a run."""

    weights: np.ndarray
    steps: np.ndarray

    def tags(self, rows: np.ndarray) -> np.ndarray:
        """Best tags of runs of one length; ``rows``: [run, token, feature]."""
        scores = self.weights[rows].sum(2)
        best = scores[:, 0] + self.steps[OUTSIDE]
        back = []
        for k in range(1, rows.shape[1]):
            paths = best[:, :, None] + self.steps
            back.append(paths.argmax(1))
            best = paths.max(1) + scores[:, k]
        tag = (best + self.steps[:, OUTSIDE]).argmax(1)
        out = [tag]
        for b in reversed(back):
            tag = b[np.arange(len(tag)), tag]
            out.append(tag)
        return np.stack(out[::-1], 1)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def slopes(field: Field, rows: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags of runs of one length and its slopes (forward and backward sums)."""
    n, size = tags.shape
    scores = field.weights[rows].sum(2)
    ahead = [scores[:, 0] + field.steps[OUTSIDE]]
    for k in range(1, size):
        ahead.append(_sum_exp(ahead[-1][:, :, None] + field.steps, 1) + scores[:, k])
    behind = [np.tile(field.steps[:, OUTSIDE], (n, 1))]
    for k in range(size - 1, 0, -1):
        behind.append(_sum_exp(field.steps + (behind[-1] + scores[:, k])[:, None, :], 2))
    behind.reverse()
    total = _sum_exp(ahead[-1] + behind[-1], 1)
    one = np.eye(3)[tags]
    by_tag = one - np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - total[:, None, None])
    by_row = np.stack([np.bincount(rows.ravel(), np.repeat(by_tag[:, :, t].ravel(), rows.shape[2]), len(field.weights)) for t in range(3)], 1)
    by_step = np.zeros((3, 3))
    by_step[OUTSIDE] += by_tag[:, 0].sum(0)
    by_step[:, OUTSIDE] += by_tag[:, -1].sum(0)
    for k in range(1, size):
        pairs = ahead[k - 1][:, :, None] + field.steps + (scores[:, k] + behind[k])[:, None, :] - total[:, None, None]
        by_step += (one[:, k - 1, :, None] * one[:, k, None, :] - np.exp(pairs)).sum(0)
    path = [OUTSIDE * np.ones(n, int), *tags.T, OUTSIDE * np.ones(n, int)]
    likely = (scores * one).sum((1, 2)) + sum(field.steps[a, b] for a, b in zip(path, path[1:])) - total
    return float(likely.sum()), by_row, by_step


_NEVER = -1e6


def fit(runs: list[tuple[list[int], list[int]]], rounds: int = 12, rate: float = 0.3, pull: float = 1e-3, seed: int = 3) -> Field:
    """The field of the greatest penalised likelihood of ``runs`` (features of all tokens, tags), by AdaGrad."""
    steps = np.zeros((3, 3))
    steps[OUTSIDE, INSIDE] = _NEVER
    field = Field(np.zeros((ROWS, 3)), steps)
    field.weights[_crc("bias"), OUTSIDE] = 1.0
    if not any(any(tags) for _, tags in runs):
        field.weights[_crc("bias"), OUTSIDE] = -_NEVER
        return field
    by_size: dict[int, list] = {}
    for rows, tags in runs:
        by_size.setdefault(len(tags), []).append((rows, tags))
    random = np.random.default_rng(seed)
    batches = []
    for size, own in sorted(by_size.items()):
        rows = np.array([r for r, _ in own]).reshape(len(own), size, FEATURES)
        tags = np.array([t for _, t in own])
        order = random.permutation(len(own))
        batches += [(rows[order[k : k + 256]], tags[order[k : k + 256]]) for k in range(0, len(own), 256)]
    seen, seen_steps = np.full_like(field.weights, 1e-6), np.full_like(steps, 1e-6)
    for _ in range(rounds):
        for k in random.permutation(len(batches)):
            _, by_row, by_step = slopes(field, *batches[k])
            by_row = by_row / len(batches[k][0]) - pull * field.weights
            by_step = by_step / len(batches[k][0])
            seen += by_row**2
            seen_steps += by_step**2
            field.weights += rate * by_row / np.sqrt(seen)
            field.steps += rate * by_step / np.sqrt(seen_steps)
            field.steps[OUTSIDE, INSIDE] = _NEVER
    return field


def train(docs: DataFrame, text: str = "text", most: int = MOST_RUNS) -> Field:
    """A field for ``docs``, from at most 2 x ``most`` runs."""
    return fit([(r.rows, r.tags) for r in labelled_runs(docs, text, most).collect()])


def found(texts: list[bytes], field: Field) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Base spans and all spans of some texts, as (kind, start, end) in code points."""
    p = Portion.of(texts)
    base = _plain_of(p)
    extra: dict[int, list] = {}
    files, by_size = p.files(), {}
    for r in p.runs():
        by_size.setdefault(len(r), []).append(r)
    for runs in by_size.values():
        rows = np.array([[features(p.sight(i, files[int(p.own[i])])) for i in r] for r in runs])
        for r, tags in zip(runs, field.tags(rows)):
            for i, tag in zip(r, tags):
                if tag == OUTSIDE:
                    continue
                t, a, b = _place(p, i)
                if tag == BEGIN:
                    extra.setdefault(t, []).append([a, b])
                else:
                    extra[t][-1][1] = b
    bases, every = [], []
    for t, by_kind in enumerate(base):
        own = sorted((a, KINDS.index(k), b) for k, spans in by_kind.items() for a, b, _ in spans)
        more = [(a, KINDS.index("secret"), b) for a, b in extra.get(t, []) if a < b and all(b <= x or y <= a for x, _, y in own)]
        for out, spans in ((bases, own), (every, sorted(own + more))):
            out.append(_in_points(p.texts[t], [(KINDS[k], a, b) for a, k, b in spans]))
    return bases, every


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, field: Field, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two lists of spans (kind, start, end) in place of columns so named:
    plain ones, and all with those of the field (kind ``secret``), which touch no plain one."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in (base.lower(), spans.lower())])
    where = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            parts = [found(t, shared.value) for t in _portions(batch.column(where))]
            lists = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in one] for part in parts for one in part[i]], _ARROW_SPAN) for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, base, spans])

    empty = F.lit(None).cast(_SPAN)
    out = docs.withColumn(base, empty).withColumn(spans, empty).schema
    return docs.mapInArrow(run, out)
