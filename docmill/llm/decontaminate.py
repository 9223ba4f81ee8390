"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items are put into one suffix automaton. A
document's words are streamed through it; after each word the automaton's state
and the length of the longest item passage that ends here are known, so a
document costs one step per word, whatever the number of items. Where the
length reaches the window, all its words are hit; items shorter than a window
count as a whole.

The automaton is built on the driver from the benchmark (not the corpus) and
broadcast in blocks of at most ``BLOCK_WORDS`` item words; each block is one
narrow pass over the documents, so nothing is shuffled. Between blocks the
state is a table. Words: ASCII letters in lower case, digits, and everything
above ASCII; the rest separates.
"""
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from docmill.llm import worker
from docmill.llm.names import fresh
from docmill.session import cut_lineage

#: Item words per broadcast automaton (about 1 KB each in a worker).
BLOCK_WORDS = 50_000
#: Texts that go back from a worker at once.
ROWS_TOGETHER = 512
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_SPACES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACES).split()


class SuffixAutomaton:
    """Of the words of many items; windows and short items are marked on its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.steps: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(items)

    def _new(self, length, steps, link):
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p, w, q):
        """The state reached from p by w, so that its longest passage is p's and w."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.steps[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(w) == q:
            self.steps[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last, w):
        if w in self.steps[last]:
            return self._split(last, w, self.steps[last][w])
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.steps[p]:
            self.steps[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.steps[p][w])
        return new

    def _mark(self, items):
        #: state -> the state of its last ``window`` words
        self.at_window = list(range(len(self.link)))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[self.link[v]] >= self.window:
                self.at_window[v] = self.at_window[self.link[v]]
        self.window_items: dict[int, set] = {}
        self.short_items: dict[int, list] = {}
        for item, words in items:
            s = 0
            for n, w in enumerate(words, 1):
                s = self.steps[s][w]
                if n >= self.window:
                    self.window_items.setdefault(self.at_window[s], set()).add(item)
            if 0 < len(words) < self.window:
                self.short_items.setdefault(s, []).append((len(words), item))
        #: state -> the nearest state up its links that ends a short item, or -1
        self.short_at = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short_at[v] = v if v in self.short_items else self.short_at[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [first, end) of hit words, as found, and the items hit."""
        steps, link, length, window = self.steps, self.link, self.length, self.window
        short_at, root = self.short_at, self.steps[0]
        spans: list[list[int]] = []
        found: set = set()
        s = n = 0
        here = root
        for i, w in enumerate(words):
            to = here.get(w)
            if to is None:
                if w not in root:
                    if s:
                        s = n = 0
                        here = root
                    continue
                while to is None:
                    s = link[s]
                    to = steps[s].get(w)
                n = length[s]
            s = to
            n += 1
            here = steps[s]
            if n >= window:
                found |= self.window_items[self.at_window[s]]
                if spans and spans[-1][0] == i + 1 - n:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i + 1 - n, i + 1])
            u = short_at[s]
            while u >= 0:
                for size, item in self.short_items[u]:
                    if size <= n:
                        found.add(item)
                        spans.append([i + 1 - size, i + 1])
                u = short_at[link[u]]
        return spans, found


def united(spans: list) -> list[tuple[int, int]]:
    """Sorted spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_MATCH = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW_MATCH = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def _blocks(items: DataFrame, item: str, text: str, block_words: int):
    """Lists of (id, words) of at most so many words, or one longer item."""
    block, n = [], 0
    rows = items.where(F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    for name, content in rows.toLocalIterator():
        words = words_of(content.encode())
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        if words:
            block.append((name, words))
            n += len(words)
    if block:
        yield block


def _matched(docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, window: int, block_words: int, name: str, finish=None) -> DataFrame:
    """``docs`` with the column ``name`` (n_words, spans of hit words, ids of items), or what
    ``finish`` makes of its batches, in the columns of ``docs``: in the same worker, since
    each Python step of a task has a worker of its own, which stays in memory."""
    spark = docs.sparkSession
    out = docs.withColumn(name, F.lit(None).cast(_MATCH))
    at = len(docs.columns)
    where = docs.columns.index(text)
    blocks = _blocks(items, item, item_text, block_words)
    block, more = next(blocks, []), next(blocks, None)
    while block is not None:
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        def run(batches, automaton=automaton, finish=finish if more is None else None):
            worker.kept("decontamination", dict)
            scan = automaton.value.scan
            for batch in (whole.slice(k, ROWS_TOGETHER) for whole in batches for k in range(0, whole.num_rows, ROWS_TOGETHER)):
                match = []
                for content, old in zip(batch.column(where), batch.column(at)):
                    words = words_of((content.as_py() or "").encode())
                    spans, found = scan(words)
                    old = old.as_py()
                    if old:
                        spans += [(s["first"], s["end"]) for s in old["spans"]]
                        found |= set(old["items"])
                    match.append({
                        "n_words": len(words), "spans": [{"first": a, "end": b} for a, b in united(spans)],
                        "items": sorted(x for x in found if x is not None),
                    })
                matched = pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], pa.array(match, _ARROW_MATCH)], names=batch.schema.names
                )
                yield finish(matched) if finish else matched

        out = out.mapInArrow(run, docs.schema if finish and more is None else out.schema)
        if more is None:
            break
        out = cut_lineage(out)  # so that one automaton at a time is in a worker
        block, more = more, next(blocks, None)
    return out


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (maximal runs of hit words, as word
    numbers from 0, end exclusive) and ``items`` (ids of items with occurring
    windows, sorted as texts).

    Columns of these names are replaced. A null text has no words, a null or
    wordless item no window; an item without an id still makes hits, but is not
    listed. Repeated rows are treated each for itself; an empty benchmark hits
    nothing.
    """
    own = ["n_words", "spans", "items"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    (name,) = fresh(docs, "match")
    out = _matched(docs, items, text, item, item_text, window, block_words, name)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{name}.{c}").alias(c) for c in own])


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 10, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages, in the same columns.

    Every run of hit words (passages of ``window`` words and more, whole short
    items) is cut from the text, from its first word to the last with what
    stands between; a document with hits on ``coverage`` of its words or more
    goes. Texts without a hit stay as they are, null ones too.
    """
    where, own = docs.columns.index(text), len(docs.columns)

    def cut(batch):
        texts, keep = [], []
        for content, match in zip(batch.column(where), batch.column(own)):
            content, match = content.as_py(), match.as_py()
            spans = match["spans"] if match else []
            keep.append(not spans or sum(s["end"] - s["first"] for s in spans) < coverage * match["n_words"])
            if spans and keep[-1]:
                at = [m.span() for m in WORD.finditer(content)]
                parts, begin = [], 0
                for s in spans:
                    parts.append(content[begin : at[s["first"]][0]])
                    begin = at[s["end"] - 1][1]
                content = "".join([*parts, content[begin:]])
            texts.append(content)
        columns = batch.columns[:own]
        columns[where] = pa.array(texts, batch.schema.field(where).type)
        out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:own])
        return out.filter(pa.array(keep, pa.bool_()))

    return _matched(docs, items, text, item, item_text, window, block_words, fresh(docs, "match")[0], cut)
