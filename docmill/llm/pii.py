"""Personal data, also in disguise, with spans of the source text.

The plain patterns are sought in the text as it is (``base`` spans). Then
transducers rewrite the text and keep, for every character they put out, where
it came from: look-alike letters, wide and other digits, odd spaces and dashes
become ASCII and zero-width characters vanish; spelled digits become digits;
written-out "at" and "dot" become signs. The same patterns are sought in the
result, and their spans are mapped back. A disguised find counts if it doesn't
touch a plain one of its kind. Texts without any sign of disguise skip this.

Each text is looked at as a whole, in time linear in its length; texts are
independent, so it is a narrow step.
"""
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            end = match.end()
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the plain patterns by kind: leftmost, without overlap; those
    that fail their check are dropped and not tried again otherwise."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return out


# Letters that look like ASCII ones, and other signs.
_LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
# Characters without width.
_NO_WIDTH = "​‌‍⁠﻿­"
# Spelled digits.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_CHANGE = dict(_LOOK_ALIKE)
_CHANGE.update({chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})
_CHANGE.update({chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)})
_CHANGE.update(dict.fromkeys(_NO_WIDTH, ""))
_ODD = re.compile("[" + re.escape("".join(_CHANGE)) + "]")
_WORD = "(?:" + "|".join(_SPELLED) + ")"
#: At least three spelled digits, with digits, dots and a plus between or before them.
_RUN = re.compile(rf"(?i)(?:\b(?:plus[\s-]+)|\+\s*)?\b{_WORD}(?:[\s,-]+(?:(?:dot|point|dash)[\s,-]+)?(?:{_WORD}|[0-9]{{1,3}})){{2,}}\b")
_TOKEN = re.compile(rf"(?i)plus|\+|dot|point|dash|{_WORD}|[0-9]")
_BRACKET = re.compile(r"(?i)\s*(?:\[\s*(?:(at)|@|(dot)|\.)\s*\]|\(\s*(?:(at)|@|(dot)|\.)\s*\)|\{\s*(?:(at)|@|(dot)|\.)\s*\}|<\s*(?:(at)|@|(dot)|\.)\s*>)\s*")
# Last names of domains, for addresses with one sign written out, which plain prose may resemble.
_LAST = frozenset("com org net edu gov info biz io dev app test example de fr es uk eu us ca au it nl ch at be br ru jp cn in".split())
# Words of prose that are no last name, and such that are no name, where both signs are written out.
_NO_LAST = frozenset("on the and or an of that this which from with for by if then than when where but".split())
_NO_NAME = frozenset("the a an this that every each any his her its their our your my".split())
#: An address with its signs written out as words of their own.
_ADDRESS = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|\s+dot\s+)[A-Za-z0-9_%+-]++)*+(?P<at>\s+at\s+|@)(?P<domain>[A-Za-z0-9-]++(?:(?:\.|\s+dot\s+)[A-Za-z0-9-]++)++)")
_PART = re.compile(r"(?i)[A-Za-z0-9-]+(?P<sign>\.|\s+dot\s+|$)")
#: What any such address holds.
_WRITTEN = re.compile(r"(?i)\sat\s++[A-Za-z0-9-]++(?:\.|\s+dot\s)|[A-Za-z0-9-]\s++dot\s")
_SIGN = re.compile(r"(?i)\s+(at|dot)\s+")


def _written(match: re.Match) -> int:
    """End of the address in a match of ``_ADDRESS``, or -1: up to the last name
    that counts. Any name of letters does where both signs are written out, else
    those of ``_LAST``."""
    domain, words, end = match["domain"], 0, -1
    parts = list(_PART.finditer(domain))
    for before, part in zip(parts, parts[1:]):
        words += before["sign"] != "."
        name = part[0][: len(part[0]) - len(part["sign"])].lower()
        both = words and match["at"] != "@" and len(name) > 1 and name.isalpha() and name not in _NO_LAST
        if name in _LAST or both and domain[: parts[0].start("sign")].lower() not in _NO_NAME:
            end = match.start("domain") + part.start("sign")
    return end


def _addresses(text: str):
    """Spans of addresses with signs written out."""
    match = _ADDRESS.search(text)
    while match:
        end = _written(match)
        if end > 0:
            yield match.start(), end
        match = _ADDRESS.search(text, end if end > 0 else match.start("domain"))  # a domain that isn't one may begin an address


class Tape:
    """A rewritten text, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace sorted spans that don't overlap; all of a replacement's
        characters come from the whole span."""
        if not pieces:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in pieces:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _digits(match: re.Match) -> list[tuple[int, int, str]]:
    """A run of spelled digits: each word a digit, separators between them gone."""
    out, at = [], match.start()
    for m in _TOKEN.finditer(match[0]):
        a, b = match.start() + m.start(), match.start() + m.end()
        if a > at:
            out.append((at, a, ""))
        word = m[0].lower()
        new = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}.get(word) or _SPELLED.get(word, word)
        if new != m[0]:
            out.append((a, b, new))
        at = b
    return out


def disguised(text: str, low: str) -> Tape | None:
    """The rewritten text, or None if there is nothing to rewrite."""
    tape = Tape(text)
    if not text.isascii() and _ODD.search(text):
        tape.rewrite([(m.start(), m.end(), _CHANGE[m[0]]) for m in _ODD.finditer(text)])
        low = tape.text.lower()
    if "[" in low or "(" in low or "{" in low or "<" in low:
        tape.rewrite([(m.start(), m.end(), "@" if any(m.group(1, 3, 5, 7)) or "@" in m[0] else ".") for m in _BRACKET.finditer(tape.text)])
    if _WRITTEN.search(tape.text):
        tape.rewrite([
            (s.start(), s.end(), "@" if s[1].lower() == "at" else ".")
            for a, b in _addresses(tape.text) for s in _SIGN.finditer(tape.text, a, b)
        ])
    if any(w in low for w in _SPELLED):
        tape.rewrite([p for m in _RUN.finditer(tape.text) for p in _digits(m)])
    return tape if tape.starts is not None else None


def find(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans and all spans, as (kind, start, end) by kind and start; in
    code points of the source, end exclusive. A null text has none."""
    text = text or ""
    base = plain(text)
    every = {k: list(v) for k, v in base.items()}
    tape = disguised(text, text.lower())
    if tape is not None:
        for kind, spans in plain(tape.text).items():
            for a, b in spans:
                start, end = tape.source(a, b)
                if text[start:end] != tape.text[a:b] and all(end <= s or e <= start for s, e in base[kind]):
                    every[kind].append((start, end))
    listed = lambda spans: [(k, a, b) for k in KINDS for a, b in sorted(spans[k])]
    return listed(base), listed(every)


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two lists of spans (kind, start, end) in place of columns so
    named: plain ones and all. All rows stay, repeated ones too."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in (base.lower(), spans.lower())])
    where = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(where)]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], _ARROW_SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, base, spans])

    empty = F.lit(None).cast(_SPAN)
    return docs.mapInArrow(run, docs.withColumn(base, empty).withColumn(spans, empty).schema)
