"""Page cleaning: every step is a column expression over one page."""
import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill import fixed
from docmill.functions.labels import is_noise_line
from docmill.functions.stage import computed
from docmill.functions.text import let, lines, strip
from docmill.operators.bitmaps import bitmap_filter, may_hold
from docmill.session import cut_lineage

# ASCII and the Latin-1 characters that NFKC leaves alone
_NEEDS_NFKC = r"[^\x00-\x7F¡-§©«¬®°±¶·»¿-ÿ]"


@cache
def _unprintable() -> tuple[re.Pattern, re.Pattern]:
    """White space besides line feed, tab and blank; characters of category C besides those."""
    spaces, controls = [], []
    for x in map(chr, range(sys.maxunicode + 1)):
        if x in "\n\t ":
            continue
        if x.isspace():
            spaces.append(x)
        elif unicodedata.category(x)[0] == "C":
            controls.append(x)

    def ranges(found):
        runs = []
        for x in map(ord, found):
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"

    return re.compile(ranges(spaces) + "+"), re.compile(ranges(controls) + "+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(parts: pd.Series) -> pd.Series:
    """Compatibility-compose; other white space to a space; drop control characters."""
    spaces, controls = _unprintable()

    def fix(text):
        text = unicodedata.normalize("NFKC", text)
        return controls.sub("", spaces.sub(" ", text))

    return parts.map(lambda p: None if p is None else [None if t is None else fix(t) for t in p])


def map_characters(c) -> Column:
    """Ligatures, curly quotes, dashes and invisible characters."""
    out = F.translate(
        c,
        "".join(fixed.TYPOGRAPHIC) + fixed.INVISIBLE,
        "".join(fixed.TYPOGRAPHIC.values()),
    )
    for glyph, letters in fixed.LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def _fix_plain(c) -> Column:
    spaced = F.regexp_replace(c, r"[\r\x0b\x0c\x1c-\x1f]+", " ")
    dropped = F.regexp_replace(spaced, r"[\x00-\x08\x0e-\x1b\x7f]+", "")
    return F.when(c.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), dropped).otherwise(c)


def fix_unicode_parts(mapped) -> Column:
    """Fix every string of an array of mapped texts; only text with characters
    outside Latin-1 visits Python. Give a stored column: it is used twice."""
    beyond = lambda t: (F.octet_length(t) != F.length(t)) & t.rlike(_NEEDS_NFKC)
    risky = F.transform(mapped, lambda t: F.when(beyond(t), t))
    return let(
        F.struct(mapped.alias("m"), _nfkc(risky).alias("u")),
        lambda s: F.transform(s["m"], lambda t, i: F.coalesce(F.get(s["u"], i), _fix_plain(t))),
    )


def fix_unicode(c) -> Column:
    return F.get(fix_unicode_parts(F.array(map_characters(c))), F.lit(0))


def join_hyphens(c) -> Column:
    return F.regexp_replace(c, rf"([{fixed.WORD}])-\n([{fixed.WORD}])", "$1$2")


def normalise_bullets(c) -> Column:
    return F.regexp_replace(c, rf"(?md)^[{fixed.WS}]*+[{fixed.BULLETS}][{fixed.WS}]*", "- ")


def drop_noise_lines(c) -> Column:
    return F.array_join(F.filter(lines(c), lambda l: ~is_noise_line(l)), "\n")


def drop_lines(c, unwanted) -> Column:
    """Remove lines whose stripped text is in the array ``unwanted``."""
    return F.array_join(F.filter(lines(c), lambda l: ~F.array_contains(unwanted, strip(l))), "\n")


def clean_whitespace(c) -> Column:
    out = F.regexp_replace(c, r"\n{3,}", "\n\n")
    out = F.array_join(F.transform(lines(out), lambda l: F.rtrim(l, F.lit(fixed.WS_CHARS))), "\n")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def wrap_raw_tables(c) -> Column:
    """Put a marker pair around every run of two or more lines with a pipe."""
    line = r"[^\n|]*+\|[^\n]*+"
    return F.regexp_replace(
        c, rf"(?md)^{line}(?:\n{line})++", f"{fixed.TABLE_MARKER}\n$0\n{fixed.TABLE_MARKER}"
    )


def marked_parts(c) -> Column:
    """Text split at table markers; odd positions are tables."""
    return F.split(c, fixed.TABLE_MARKER, -1)


def page_parts(text) -> Column:
    wrapped = F.array_join(
        F.transform(marked_parts(text), lambda p, i: F.when(i % 2 == 0, wrap_raw_tables(p)).otherwise(p)),
        fixed.TABLE_MARKER,
    )
    return marked_parts(wrapped)


def _every_other(parts, parity: int) -> Column:
    return F.filter(parts, lambda p, i: i % 2 == parity)


def _assemble(prose, tables, unwanted) -> Column:
    def finish(p):
        kept = F.filter(lines(p), lambda l: ~is_noise_line(l) & ~F.array_contains(unwanted, strip(l)))
        return clean_whitespace(F.array_join(kept, "\n"))

    def part(p, i):
        table = F.get(tables, i)
        block = F.concat(F.lit(f"\n\n{fixed.TABLE_OPEN}\n"), strip(table), F.lit(f"\n{fixed.TABLE_CLOSE}"))
        return F.array(finish(p), F.when(strip(table) != "", block).otherwise(F.lit("")))

    pieces = F.flatten(F.transform(prose, part))
    return F.array_join(F.filter(pieces, lambda s: strip(s) != ""), "\n\n")


def edge_lines(text) -> Column:
    """Distinct first three and last three non-blank lines of a page."""
    return let(
        F.filter(F.transform(lines(text), strip), lambda l: l != ""),
        lambda ls: F.array_distinct(
            F.concat(F.slice(ls, 1, 3), F.slice(ls, F.greatest(F.size(ls) - 2, F.lit(1)), 3))
        ),
    )


def header_footer_lines(pages: DataFrame) -> DataFrame:
    """(doc_name, line, pages): edge lines seen on at least three pages."""
    return (
        pages.select("doc_name", F.explode(edge_lines(F.col("text"))).alias("line"))
        .where(F.length("line").between(6, 199))
        .groupBy("doc_name", "line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= 3)
    )


def prepare_pages(pages: DataFrame) -> DataFrame:
    """Split pages into ``_prose`` and ``_tables`` and fix the prose characters."""
    parts = let(
        page_parts(F.col("text")),
        lambda a: F.struct(
            F.transform(_every_other(a, 0), map_characters).alias("prose"), _every_other(a, 1).alias("tables")
        ),
    )
    split = computed(pages, _parts=parts)
    fixed_prose = F.transform(
        fix_unicode_parts(F.col("_parts.prose")), lambda p: normalise_bullets(join_hyphens(p))
    )
    return computed(split, _prose=fixed_prose).withColumn("_tables", F.col("_parts.tables")).drop("_parts")


def unwanted_lines(prepared: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """(doc_name, page, unwanted): the page's own boilerplate lines.

    A line that is no boilerplate is dropped by the filter before anything moves.
    What is left is keyed by (doc_name, line), never by document alone, so that a
    huge document spreads; a page's hits are bounded by the page.
    """
    on_page = let(
        F.col("_prose"),
        lambda parts: F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(lines(p), strip)))),
    )
    tested = prepared.select("doc_name", "page", on_page.alias("_lines")).join(F.broadcast(bitmap_filter(boilerplate, "doc_name", "line")))
    likely = F.filter("_lines", lambda l: F.length(l).between(6, 199) & may_hold("doc_name", l))
    return (
        tested.select("doc_name", "page", F.explode(likely).alias("line"))
        .join(boilerplate.select("doc_name", "line"), ["doc_name", "line"], "left_semi")
        .groupBy("doc_name", "page")
        .agg(F.collect_set("line").alias("_unwanted"))
    )


def clean_pages(pages: DataFrame) -> DataFrame:
    """Clean every page of (doc_name, page, text, ...) and drop the blank ones.

    The prepared pages are stored once: the Python step runs once, and the pages
    meet only their own boilerplate lines afterwards."""
    prepared = cut_lineage(prepare_pages(pages))
    boilerplate = cut_lineage(header_footer_lines(pages).select("doc_name", "line"))
    unwanted = unwanted_lines(prepared.select("doc_name", "page", "_prose"), boilerplate)
    none = F.array().cast("array<string>")
    text = let(
        F.struct(
            F.col("_prose").alias("prose"),
            F.col("_tables").alias("tables"),
            F.coalesce(F.col("_unwanted"), none).alias("unwanted"),
        ),
        lambda s: _assemble(s["prose"], s["tables"], s["unwanted"]),
    )
    joined = prepared.join(unwanted, ["doc_name", "page"], "left")
    return computed(joined, text=text).where(strip(F.col("text")) != "").select(*pages.columns)
