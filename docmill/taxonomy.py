"""The category taxonomy is a parameter: a table of
``| ord | `CATEGORY` | keywords | title words | negatives | ...`` rows, terms
separated by commas. The default one is ``taxonomy.md`` in this package; name
another with ``DOCMILL_TAXONOMY`` or pass a path. Row order breaks ties.
"""
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, functions as F

_ROW = re.compile(r"^\|\s*(\d+)\s*\|\s*`([^`]+)`\s*\|([^|]*)\|([^|]*)\|([^|]*)\|")


@dataclass(frozen=True)
class Category:
    ord: int
    name: str
    keywords: tuple
    titles: tuple
    negatives: tuple


def normalise_term(term: str) -> str:
    return " ".join(re.sub(r"[^\w\s-]", " ", term.lower()).split())


def load_taxonomy(path: str | None = None) -> list[Category]:
    path = path or os.environ.get("DOCMILL_TAXONOMY")
    source = Path(path) if path else resources.files("docmill") / "taxonomy.md"
    found = []
    for line in source.read_text(encoding="utf-8").splitlines():
        row = _ROW.match(line)
        if row:
            terms = [
                tuple(normalise_term(t) for t in cell.split(",") if t.strip() not in ("", "—"))
                for cell in row.group(3, 4, 5)
            ]
            found.append(Category(int(row.group(1)), row.group(2), *terms))
    if not found:
        raise ValueError(f"no taxonomy rows in {source}")
    return sorted(found, key=lambda c: c.ord)


def all_terms(taxonomy: list[Category]) -> list[str]:
    return sorted({t for c in taxonomy for t in c.keywords + c.titles + c.negatives})


def longest_term_pattern(terms: list[str]) -> str:
    """A look-ahead that captures, at every position, the longest term there.

    Terms share prefixes, so one scan of the text replaces one scan per term.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def branch(keys, node):
        # halve the alternatives with one character class test each
        if len(keys) > 3:
            half = len(keys) // 2
            low, high = branch(keys[:half], node), branch(keys[half:], node)
            test = "".join(re.escape(k) for k in keys[:half])
            return f"(?:(?=[{test}]){low}|{high})"
        return "(?:" + "|".join(re.escape(k) + body(node[k]) for k in keys) + ")"

    def body(node):
        keys = sorted(k for k in node if k)
        if not keys:
            return ""
        if len(keys) == 1 and "" not in node:
            return re.escape(keys[0]) + body(node[keys[0]])
        return branch(keys, node) + ("?" if "" in node else "")

    return f"(?=({body(trie)}))"


def term_finder(terms: list[str]):
    """A function that gives the set of terms in a text."""
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile(longest_term_pattern(terms))
        return lambda text: set(pattern.findall(text))
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return lambda text: {hit for _, hit in automaton.iter(text)}


def term_hits(text, terms: list[str]) -> Column:
    """Distinct terms found anywhere in normalised text, as substrings.

    An automaton reads each text once. A worker without the optional package
    takes a pattern instead, which reports only the longest term at each
    position; its prefixes are implied, so test hits with :func:`has_term`.
    """
    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = term_finder(terms)
        for batch in batches:
            yield batch.map(lambda t: [] if t is None else sorted(find(t)))

    return scan(text)


def has_term(hits, term) -> Column:
    return F.exists(hits, lambda h: F.startswith(h, term))
