"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best split of a text into pieces maximises the sum of the pieces' scores in
the model file; of equal splits the one whose last piece is longer wins, from
the end backwards. The search goes over the text once. A later piece can only
start within the last ``longest`` characters, so only these positions are
alive; when the back pointers of all of them lead to one boundary, what lies
before it can't change any more and its ids are committed, and the window moves
on. Characters that no piece holds become the byte pieces of their UTF-8.

Between a character and a following space, and at a line feed that no piece
holds, all paths meet: no piece crosses there (looked up in the vocabulary). So
the text between two such places always gets the same ids, and these strings
are remembered from the second group of texts on that holds them: most come
once and would fill a worker's memory.

Decoding an encoded text gives exactly the text, whatever it holds: spaces
stand for the sign U+2581 of the pieces, so that sign in a text is an unknown
character.
"""
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm import worker

#: Remembered strings per generation (of two) and their greatest length.
REMEMBERED, SHORT = 100_000, 48
#: Marks of strings that came before, a byte each, and how many of them are set at most.
MARKS, MOST_MARKED = 1 << 22, 1 << 19
#: Texts that are coded together.
TOGETHER = 256
_SPACE = "▁"
_FACTOR, _PLACES = np.uint64(0x9E3779B97F4A7C15), 1 << 18


def _place(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)


class Memory:
    """Strings and their ids, in two generations, and marks by the hash of strings that
    came before. Two strings with one mark only make one of them remembered early."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    def turn(self) -> None:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        if self.marked > MOST_MARKED:
            self.marks, self.marked = bytearray(MARKS), 0

    def forget_first(self, strings) -> None:
        """Mark strings; those without a mark so far are not remembered."""
        marks, known = self.marks, self.known
        for p in strings:
            at = hash(p) % MARKS
            if not marks[at]:
                marks[at] = 1
                self.marked += 1
                del known[p]


class Pieces:
    """A model's vocabulary; small enough to be broadcast (the model file's size)."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True):
        """``pieces``: text, score and kind (normal, byte, unknown or other) by id."""
        self.dummy_prefix = dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [b""] * len(pieces)
        self.byte_id = [-1] * 256
        #: of a byte without a piece; a model without one too has -1, which has no text
        self.unknown_id = -1
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(piece[3:-1], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif kind == "unknown":
                self.unknown_id = i
            elif kind == "normal":
                piece = piece.replace(_SPACE, " ")
                self.bytes[i] = piece.encode()
                self.score[piece], self.id[piece] = score, i
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10
        crossing = any(re.search("[^ ] ", p) for p in self.score)
        line_feed = any("\n" in p for p in self.score)
        #: strings between places where all paths meet
        self.apart = None if crossing else re.compile(" *[^ ]+| +") if line_feed else re.compile("\n| *[^ \n]+| +")
        #: characters that pieces have next to each other; between others, paths meet
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self._layers = self._hashed()
        self._name = ("pieces", len(pieces), dummy_prefix, hash(tuple(sorted(self.score.items()))))

    @staticmethod
    def load(path: str, dummy_prefix: bool = True) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def kind(i):
            other = model.is_control(i) or model.is_unused(i)
            return "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "other" if other else "normal"

        return Pieces(
            [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())], dummy_prefix
        )

    def search(self, text: str) -> list[int]:
        """Ids of a text, by the streaming search."""
        ids: list[int] = []
        get, longest = self.score.get, self.longest
        base = 0  # all before this boundary is committed
        best, back = [0.0], [0]  # of the boundaries from base on
        for end in range(1, len(text) + 1):
            top, at = -np.inf, end - 1
            for start in range(max(base, end - longest), end):
                score = get(text[start:end])
                if score is not None and best[start - base] + score > top:
                    top, at = best[start - base] + score, start
            if text[end - 1] not in self.score and best[end - 1 - base] + self.unknown > top:
                top, at = best[end - 1 - base] + self.unknown, end - 1
            best.append(top)
            back.append(at)
            if end - base >= 4 * longest:
                meet = self._meet(back, base, end)
                if meet > base:
                    ids += self._ids(text, back, base, meet)
                    best, back, base = best[meet - base :], back[meet - base :], meet
        return ids + self._ids(text, back, base, len(text))

    def _meet(self, back, base, end):
        """The last boundary on every surviving path."""
        alive = set(range(max(base, end - self.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last - base])
        return alive.pop()

    def _ids(self, text, back, base, end):
        cuts = [end]
        while cuts[-1] > base:
            cuts.append(back[cuts[-1] - base])
        ids: list[int] = []
        for a, b in zip(cuts[::-1], cuts[-2::-1]):
            i = self.id.get(text[a:b])
            ids += [i] if i is not None else [self.byte_id[x] if self.byte_id[x] >= 0 else self.unknown_id for x in text[a:b].encode()]
        return ids

    def _hashed(self):
        """The pieces by the hash of their characters: tables of hashes and
        places in the list of pieces, a further one for what falls on the same place."""
        pieces = list(self.score)
        h = np.zeros(len(pieces), np.uint64)
        for n in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == n]
            c = np.array([pieces[i] for i in at], f"<U{n}").view(np.uint32).reshape(-1, n)
            for k in range(n):
                h[at] = h[at] * _FACTOR + c[:, k] + np.uint64(1)
        # the last entry is for strings that are no piece
        self._score_at = np.array([*self.score.values(), -np.inf])
        self._id_at = np.array([*(self.id[p] for p in pieces), -1], np.int32)
        left, layers = np.arange(len(pieces), dtype=np.int32), []
        while len(left):
            keys, values = np.zeros(_PLACES, np.uint64), np.full(_PLACES, -1, np.int32)
            place, first = np.unique(_place(h[left]), return_index=True)
            keys[place], values[place] = h[left[first]], left[first]
            layers.append((keys, values))
            left = np.delete(left, first)
        return layers

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        """The place of the piece with each hash; -1 where there is none."""
        place = _place(h)
        out = np.full(h.shape, -1, np.int32)
        for keys, values in self._layers:
            out = np.where(keys[place] == h, values[place], out)
        return out

    def search_many(self, parts: list[str]) -> list[bytes]:
        """The ids of many short strings: the same search, for all strings of a
        length at once."""
        out = [b""] * len(parts)
        lengths = np.array([len(p) for p in parts])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            c = np.array([parts[i] for i in at], f"<U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            h, found = np.zeros(c.shape, np.uint64), [None]
            for k in range(1, min(self.longest, n) + 1):
                h = h[:, : n - k + 1] * _FACTOR + c[:, k - 1 :]
                found.append(self._pieces(h).T.copy())
            best, back = np.full((n + 1, len(at)), -np.inf), np.zeros((n + 1, len(at)), np.int32)
            # the piece that ends at a boundary on the best path to it
            ids = np.full((n + 1, len(at)), -1, np.int32)
            best[0] = 0
            for end in range(1, n + 1):
                for k in range(min(self.longest, end), 0, -1):
                    piece = found[k][end - k]
                    score = self._score_at[piece]
                    new = best[end - k] + (score if k > 1 else np.where(piece < 0, self.unknown, score))
                    better = new > best[end]
                    best[end][better] = new[better]
                    back[end][better] = end - k
                    ids[end][better] = piece[better]
            columns, cut = np.arange(len(at)), np.full(len(at), n)
            on_path, strange = np.zeros((n + 1, len(at)), bool), np.zeros(len(at), bool)
            while len(columns):
                on_path[cut, columns] = True
                strange[columns] |= ids[cut, columns] < 0
                cut = back[cut, columns]
                columns, cut = columns[cut > 0], cut[cut > 0]
            coded = self._id_at[ids.T[on_path.T]].tobytes()
            ends = (4 * np.cumsum(on_path.sum(0))).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends], ends):
                out[i] = coded[a:b]
            for j in np.flatnonzero(strange).tolist():  # characters that become bytes
                out[at[j]] = np.array(self._ids(parts[at[j]], back[:, j].tolist(), 0, n), np.int32).tobytes()
        return out

    def _learn(self, parts: set[str], memory: "Memory") -> list[str]:
        """Put the ids of short strings into the memory; those of a word with signs behind
        it are put together. Returns the strings that were not in either generation."""
        known, older, signed, new = memory.known, memory.older, [], set()
        for p in parts:
            if (found := older.get(p)) is not None:
                known[p] = found
                continue
            core = p.rstrip(".,;:!?")
            if core != p and core.strip() and p[len(core) - 1 : len(core) + 1] not in self.pairs:
                signed.append((p, core, p[len(core) :]))
                new.update(x for x in (core, p[len(core) :]) if x not in known)
            else:
                new.add(p)
        for p in [p for p in new if p in older]:
            known[p] = older[p]
            new.remove(p)
        new = list(new)
        known.update(zip(new, self.search_many(new)))
        for p, core, tail in signed:
            known[p] = known[core] + known[tail]
        return new + [p for p, _, _ in signed]

    @worker.acyclic
    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as 32-bit integers in the machine's order."""
        texts = [" " + t if t and self.dummy_prefix else t for t in texts]
        if self.apart is None:
            return [np.array(self.search(t), np.int32).tobytes() for t in texts]
        memory = worker.kept(self._name, Memory)
        memory.turn()
        known = memory.known
        split = [self.apart.findall(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        long = {p: np.array(self.search(p), np.int32).tobytes() for p in new if len(p) > SHORT}
        learnt = self._learn(new - long.keys(), memory)
        if long:
            coded = [b"".join([known[p] if p in known else long[p] for p in parts]) for parts in split]
        else:
            coded = [b"".join(map(known.__getitem__, parts)) for parts in split]
        memory.forget_first(learnt)
        return coded

    def decode(self, ids) -> str:
        n = len(self.bytes)
        text = b"".join([self.bytes[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _lists(coded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def texts_of(lists: pa.ListArray, table: pa.BinaryArray, dummy_prefix: bool) -> pa.StringArray:
    """The texts of lists of ids: the bytes of all ids are taken at once, one
    behind the other, and cut where the lists end."""
    ids = lists.flatten().fill_null(-1).to_numpy()
    ids = np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1)
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1, 4 * taken.offset)
    data = taken.buffers()[2] or pa.py_buffer(b"")
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        found = data[a:b].to_pybytes()
        out.append(found[1:] if dummy_prefix and found[:1] == b" " else found)
    try:
        return pa.array(out, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in out], pa.string())


def encode(docs: DataFrame, model: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (array of int, in place of a
    column of that name). A null or empty text has no ids; repeated rows stay.
    A narrow step: the vocabulary is broadcast, nothing is shuffled."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() != ids.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches):
        pieces = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                lists = _lists(pieces.encode_many([x.as_py() or "" for x in part.column(where)]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, docs.withColumn(ids, F.expr("cast(null as array<int>)")).schema)


def round_trip(docs: DataFrame, model: Pieces, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` as ``decode(encode(docs))`` has them, in one step: a worker holds one
    vocabulary, and texts and ids pass to it once."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in (ids.lower(), decoded.lower())])
    shared = docs.sparkSession.sparkContext.broadcast((model, pa.array([*model.bytes, b""], pa.binary())))
    where = docs.columns.index(text)

    def run(batches):
        pieces, table = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                lists = _lists(pieces.encode_many([x.as_py() or "" for x in part.column(where)]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, texts_of(lists, table, pieces.dummy_prefix)], names=[*part.schema.names, ids, decoded])
            worker.trim()

    return docs.mapInArrow(run, docs.withColumn(ids, F.expr("cast(null as array<int>)")).withColumn(decoded, F.lit("x")).schema)


def decode(docs: DataFrame, model: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids. Null and empty lists give an
    empty text; ids that the vocabulary has no text for, none."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == ids or c.lower() != text.lower()])
    # the last entry is for ids without a text
    shared = docs.sparkSession.sparkContext.broadcast((pa.array([*model.bytes, b""], pa.binary()), model.dummy_prefix))
    where = docs.columns.index(ids)

    def run(batches):
        table, dummy_prefix = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(part.column(where), table, dummy_prefix)], names=[*part.schema.names, text])

    return docs.mapInArrow(run, docs.withColumn(text, F.lit("x")).schema)
