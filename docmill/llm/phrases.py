"""Collocations: phrases that stand together more often than their parts suggest.

Level by level, as in Apriori: a phrase of k words can only be frequent if its
first and its last k - 1 words are. Texts are encoded once as numbers of the
frequent words of their language (0: a break, or any other word). Then for each
length

* candidates: pairs of a frequent phrase and the word behind it, as the texts
  hold them. Tasks add up their own pairs, Spark sums these; a pair too rare, or
  whose last k - 1 words are no frequent phrase, is no candidate;
* counts: the candidates become a double-array trie, which is broadcast. A task
  advances the trie states of all its text positions at once, level by level, in
  numpy, and counts the accepting states with one ``bincount``. Spark sums the
  tasks' counts. These are the counts of the result.

What is broadcast is bounded: ``BLOCK_WORDS`` words of a vocabulary and
``BLOCK_PHRASES`` phrases of a trie at once. Of more, the next block takes its own
pass over the encoded texts, so nothing is left out. No text, language or phrase
is ever gathered in one task; a frequent word is one row per task.

Null languages count as ``und``; a null or empty text has no words; repeated rows
count as often as they stand there. Without frequent phrases there are no rows.
"""
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docmill.operators.numbering import numbered
from docmill.session import cut_lineage

LEAST, LONGEST, MOST = 100, 5, 2000
BLOCK_WORDS, BLOCK_PHRASES = 500_000, 200_000
#: Words, or pairs, that a task holds before it hands on its sums.
HELD = 250_000
#: States whose counts travel together.
CELLS = 4096
#: Text positions whose states are advanced at once.
POSITIONS = 1_000_000
_CUTS = b".,;:!?\n\x0b\x0c\r"
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _CUTS else 32 if c == 9 else c for c in range(256))


def _texts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    return docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` of every word."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        fresh = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = text.as_py().translate(_SIGNS).split()
                held[lang].update(words)
                fresh += len(words)
                if fresh > HELD // 4:
                    fresh = 0
                    if sum(map(len, held.values())) > HELD:
                        yield from out(held)
        yield from out(held)

    def out(held):
        for lang, words in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())],
                names=["lang", "word", "n"],
            )
        held.clear()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def encoded(texts: DataFrame, words: DataFrame, size: int, block: int = BLOCK_WORDS) -> DataFrame:
    """``codes`` of every text: 1 + ``id`` of each frequent word, 0 for other words,
    at breaks and at the end. ``words``: lang, word, id below ``size``."""
    rows = texts
    for first in range(0, max(size, 1), block):
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, n in words.where(F.col("id").between(first, first + block - 1)).select("lang", "word", "id").toLocalIterator():
            known[lang][word.encode()] = n + 1
        shared = texts.sparkSession.sparkContext.broadcast(dict(known))
        last = first + block >= size

        def run(batches, shared=shared, first=first, last=last):
            for batch in batches:
                lists, at = [], 0
                for i in range(batch.num_rows):
                    tokens = [t for t in batch.column(1)[i].as_buffer().to_pybytes().translate(_SIGNS).replace(b"\n", b" \n ").split(b" ") if t]
                    codes = np.fromiter(map(shared.value.get(batch.column(0)[i].as_py(), {}).get, tokens, repeat(0)), np.int32, len(tokens))
                    codes = np.append(codes, np.int32(0))
                    if first:
                        codes = np.where(codes > 0, codes, batch.column(2)[i].values.to_numpy())
                    lists.append(codes)
                    if i == batch.num_rows - 1 or len(lists) == 500 or len(codes) > POSITIONS // 4:
                        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                        column = pa.ListArray.from_arrays(ends, np.concatenate(lists))
                        rest = [] if last else [c.slice(at, len(lists)) for c in batch.columns[:2]]
                        yield pa.RecordBatch.from_arrays([*rest, column], names=["codes"] if last else ["lang", "text", "codes"])
                        lists, at = [], i + 1

        rows = cut_lineage(rows.mapInArrow(run, "codes array<int>" if last else "lang string, text string, codes array<int>"))
        shared.unpersist()
    return rows


class Trie:
    """A double array of phrases of one length: from state ``s`` the word of code
    ``c`` leads to ``t = base[s] + c`` if ``check[t] == s``."""

    def __init__(self, phrases: np.ndarray):
        """``phrases``: a row of word numbers (from 1) each; ``state`` gets the
        accepting state of each row."""
        self.words, codes = np.unique(phrases, return_inverse=True)
        codes = codes.reshape(phrases.shape) + 1
        self.length, wide = phrases.shape[1], len(self.words)
        self.base = np.zeros(4 * wide + 640, np.int32)
        self.check = np.full(len(self.base), -1, np.int32)
        self.check[0] = -2
        self.free, self.end, self.wide = wide + 1, wide + 1, wide
        states = np.zeros(len(phrases), np.int64)
        for level in range(self.length):
            order = np.lexsort((codes[:, level], states))
            pairs = np.stack([states, codes[:, level]], 1)[order]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(1)
            nodes = pairs[new]
            cuts = np.flatnonzero(np.diff(nodes[:, 0], prepend=-1))
            targets = np.zeros(len(nodes), np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(nodes))):
                targets[a:b] = self._place(nodes[a, 0], nodes[a:b, 1])
            states = np.empty_like(states)
            states[order] = targets[np.cumsum(new) - 1]
        self.base, self.check = self.base[: self.end + wide + 1].copy(), self.check[: self.end + wide + 1].copy()
        self.state = states

    def _place(self, state: int, codes: np.ndarray) -> np.ndarray:
        """Free cells for all children of a state: a place among some that takes them
        all, else behind all that is used."""
        if state == 0:
            base = 0
        else:
            while self.check[self.free] != -1:
                self.free += 1
            # the first gaps, and places all over what is used, of which the later ones are sparse
            near = self.free + np.flatnonzero(self.check[self.free : self.free + 256] == -1)[:32] - codes[0]
            bases = np.append(near[near >= 0], np.linspace(1, self.end, 96, dtype=np.int64))
            fits = (self.check[bases[:, None] + codes] == -1).all(1)
            base = int(bases[fits.argmax()]) if fits.any() else self.end + 1 - int(codes[0])
        cells = base + codes
        if cells[-1] + 2 * self.wide + 300 >= len(self.check):
            more = max(len(self.check), self.wide + len(codes))
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))
        self.base[state], self.check[cells] = base, state
        self.end = max(self.end, int(cells[-1]))
        return cells

    def codes(self) -> np.ndarray:
        """Code by word number; 0: none of the trie's words."""
        out = np.zeros((int(self.words[-1]) if len(self.words) else 0) + 2, np.int32)
        out[self.words] = np.arange(1, len(self.words) + 1)
        return out

    def advance(self, codes: np.ndarray, starts: int):
        """Positions below ``starts`` at which a whole phrase begins, and its states."""
        at = np.flatnonzero(codes[:starts])
        at = at[self.check[codes[at]] == 0]  # children of the root
        states = codes[at]
        for level in range(1, self.length):
            step = codes[at + level]
            cells = self.base[states] + step
            on = (step > 0) & (self.check[cells] == states)
            at, states = at[on], cells[on]
        return at, states


def _windows(batch: pa.RecordBatch):
    """Codes of a batch in parts: (codes with some behind, positions to start at)."""
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    for a in range(0, len(flat), POSITIONS):
        part = flat[a : a + POSITIONS + LONGEST]
        yield np.append(part, np.zeros(LONGEST, np.int32)), min(POSITIONS, len(flat) - a)


def _local(trie: Trie, lookup: np.ndarray, words: np.ndarray) -> np.ndarray:
    return lookup[np.minimum(words, len(lookup) - 1)]


def _tries(phrases: DataFrame, size: int, block: int):
    """Tries over blocks of ``id``, ``words`` with the ids of their rows, shared with all workers."""
    for first in range(0, size, block):
        rows = phrases.where(F.col("id").between(first, first + block - 1)).select("id", "words").toArrow()
        k = len(rows["words"][0])
        words = rows["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        trie = Trie(words)
        owner = np.full(len(trie.base), -1, np.int64)
        owner[trie.state] = rows["id"].to_numpy()
        yield phrases.sparkSession.sparkContext.broadcast((trie, owner))


def _counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts by key."""
    keys, counts = (np.concatenate(x) for x in zip(*pairs))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts], np.add.reduceat(counts[order], cuts)


def continued(coded: DataFrame, shared, whole: bool) -> DataFrame:
    """``pair`` (phrase id and number of the word behind it) and how often tasks saw it.

    If the trie holds the ``whole`` level, only where the next phrase begins one word
    later, since that is the end of what the pair makes."""

    def run(batches):
        trie, owner = shared.value
        lookup, held, size = trie.codes(), [], 0
        for batch in batches:
            for words, starts in _windows(batch):
                at, states = trie.advance(_local(trie, lookup, words), starts)
                behind = words[at + trie.length]
                on = behind > 0
                if whole and len(at):
                    # the last start of a part has its successor in the next one
                    on &= np.append(at[1:] == at[:-1] + 1, False) | (at == starts - 1)
                held.append(np.unique(owner[states[on]] << 32 | behind[on], return_counts=True))
                size += len(held[-1][0])
                if size > 2 * HELD:
                    held = [_counted(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield rows(held.pop())
                        size = 0
        if held:
            yield rows(_counted(held))

    def rows(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["pair", "n"])

    return coded.mapInArrow(run, "pair long, n long")


def counted(coded: DataFrame, shared) -> DataFrame:
    """``id`` and ``n`` of a trie's phrases in the texts, summed over all tasks.

    A task hands on its counts as arrays of ``CELLS`` states; they are added up as
    they come in, one array per part of the trie."""
    trie = shared.value[0]
    parts = -(-len(trie.base) // CELLS)
    tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        trie = shared.value[0]
        lookup, total = trie.codes(), np.zeros(parts * CELLS, np.int64)
        for batch in batches:
            for words, starts in _windows(batch):
                total += np.bincount(trie.advance(_local(trie, lookup, words), starts)[1], minlength=len(total))
        seen = np.flatnonzero(total.reshape(parts, CELLS).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([total[p * CELLS : (p + 1) * CELLS].tobytes() for p in seen], pa.binary())], names=["part", "counts"])

    def add_up(batches):
        owner, sums = shared.value[1], {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(counts.as_buffer(), np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(owner[part * CELLS + seen]), pa.array(counts[seen])], names=["id", "n"])

    return coded.mapInArrow(count, "part long, counts binary").repartition(min(parts, tasks), "part").mapInArrow(add_up, "id long, n long")


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK_PHRASES, words_block: int = BLOCK_WORDS):
    """Two tables: the frequent phrases (``k``, ``lang``, ``phrase``, ``n``), and all words per ``lang`` (``n``)."""
    words = cut_lineage(word_counts(texts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = cut_lineage(numbered(words.where(F.col("n") >= least), "id"))
    frequent = frequent.select("id", "lang", F.col("word").alias("phrase"), "n", F.array((F.col("id") + 1).cast("int")).alias("words"))
    vocabulary, size = frequent.select("id", "lang", F.col("phrase").alias("word")), frequent.count()
    levels = [frequent]
    if size:
        coded = encoded(texts, vocabulary, size, words_block)
    for k in range(2, longest + 1):
        if not size:
            break
        pairs = []
        for shared in _tries(frequent, size, block):
            # an id lies in one block, so its pairs do
            pairs.append(cut_lineage(continued(coded, shared, size <= block).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair")))
            shared.unpersist()
        found = _united(pairs).select(F.shiftright("pair", 32).alias("id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("behind"))
        found = found.join(frequent.select("id", "lang", "phrase", "words"), "id").join(
            vocabulary.select((F.col("id") + 1).cast("int").alias("behind"), "word"), "behind"
        ).select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("words", F.array("behind")).alias("words"))
        if k > 2:
            tail = F.slice("words", 2, k - 1)
            found = found.join(frequent.select(F.col("words").alias("tail")), tail == F.col("tail"), "left_semi")
        candidates = cut_lineage(numbered(found, "id"))
        size = candidates.count()
        if not size:
            break
        counts = []
        for shared in _tries(candidates, size, block):
            counts.append(cut_lineage(counted(coded, shared)))
            shared.unpersist()
        frequent = cut_lineage(numbered(candidates.join(_united(counts).where(F.col("n") >= least), "id").drop("id"), "id"))
        size = frequent.count()
        levels.append(frequent)
    return _united([t.select(F.size("words").alias("k"), "lang", "phrase", "n") for t in levels]), totals


def _part(phrase: str, first, count) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, most: int = MOST,
                 block: int = BLOCK_PHRASES, words_block: int = BLOCK_WORDS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``most`` of every language.

    A phrase of 2 to ``longest`` words that stands ``least`` times or more is scored
    by its weakest cut, 1000 a n / (l r), rounded down, ties to the earliest cut. One
    that lies in a longer phrase as frequent as itself is left out.
    """
    phrases, totals = frequent_phrases(_texts(docs, F.col(lang), F.col(text)), least, longest, block, words_block)
    known = phrases.select("lang", "phrase", "n")
    chosen = phrases.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # f of a part is that of a frequent phrase: a part stands at least as often as the whole
    cuts = chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*", _part("phrase", 1, F.col("cut")).alias("left"), _part("phrase", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(totals, "lang").withColumns({"top": F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), "bottom": whole("l") * whole("r")})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = chosen.where("k > 2").select(
        "lang", "a", "phrase", F.explode(F.expr("flatten(transform(sequence(2, k - 1), w -> transform(sequence(1, k - w + 1), i -> struct(i, w))))")).alias("x")
    ).groupBy("lang", _part("phrase", F.col("x.i"), F.col("x.w")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (
        kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", rank.cast("long"))
        .where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
