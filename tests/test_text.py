"""Literal cleaning cases and property tests for order-dependent helpers."""
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docmill import fixed
from docmill.functions import text as tx
from docmill.operators import bitmaps, clean, ordering
from docmill.operators.chunk import _make_recursive_splitter, window_split


def apply(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_bullets_swallow_blank_lines(spark):
    assert apply(spark, clean.normalise_bullets, "a\n\n  • b\n•\nc") == ["a\n- b\n- c"]


def test_hyphens(spark):
    assert apply(spark, clean.join_hyphens, "exam-\nple a-\n b é-\nà 1-\n2-\n3") == ["example a-\n b éà 12-\n3"]


def test_unicode(spark):
    got = apply(spark, clean.fix_unicode, "ﬁx x y​z “q”", "plain\x07\x0b\x0cx\r\n", "ｗｉｄｅ  ①é", "é")
    assert got == ['fix x y' + 'z "q"', "plain x \n", "wide 1é", "é"]


def test_isolated_pipe_line_is_prose(spark):
    marker = fixed.TABLE_MARKER
    got = apply(spark, clean.wrap_raw_tables, "a|b\nx\nc|d\n|e\n\nf|", "|\n|")
    assert got == [f"a|b\nx\n{marker}\nc|d\n|e\n{marker}\n\nf|", f"{marker}\n|\n|\n{marker}"]


def test_long_pipe_run_does_not_overflow(spark):
    assert apply(spark, lambda c: F.length(clean.wrap_raw_tables(c)), "|\n" * 200000) == [200000 * 2 + 2 * 15 - 1 + 1]


def test_clean_page(spark):
    raw = "Head ﬁne\n\n• one-\ntwo\n12\n" + fixed.TABLE_MARKER + "\n a | b \n--- | ---\n 1 | 2\n"
    df = spark.createDataFrame([("d", 1, raw), ("d", 2, " \n"), ("d", 3, "--\n12")], "doc_name string, page long, text string")
    rows = clean.clean_pages(df).collect()
    assert [(r["page"], r["text"]) for r in rows] == [
        (1, "Head fine\n- onetwo\n\n\n\n[TABLE]\na | b \n--- | ---\n 1 | 2\n[/TABLE]")
    ]


def test_metric_and_value_cleaning(spark):
    assert apply(spark, tx.clean_cell_value, "1,000", "500,000", "10 / 20", "7 Gbps 3") == ["1,000".split(",")[0], "500", "10 /", "7 Gbps"]
    assert apply(spark, lambda c: tx.clean_cell_value(c, True), "1,000", "a 1,000", "7 Gbps 3") == ["1,000", "a 1,000", "7 Gbps"]
    assert apply(spark, tx.clean_metric_name, "Wi-Fi 6", "Flow 1, 2") == ["Wi-Fi", "Flow"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_strip_and_nfkc_equal_python(spark, values):
    assert apply(spark, tx.strip, *values) == [v.strip() for v in values]
    got = apply(spark, lambda c: F.get(clean._nfkc(F.array(c)), F.lit(0)), *values)
    for value, fixed_text in zip(values, got):
        plain = unicodedata.normalize("NFKC", value)
        assert fixed_text.split() == "".join(
            c if c in "\n\t" or c.isspace() or unicodedata.category(c)[0] != "C" else "" for c in plain
        ).split()


@pytest.mark.parametrize("length", [0, 1, 511, 512, 513, 960, 961, 1409])
def test_windows(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    want, start = [], 0
    while start < length:
        want.append(text[start:start + 512])
        if start + 512 >= length:
            break
        start += 448
    assert apply(spark, window_split, text) == [want]


def test_recursive_splitter():
    split = _make_recursive_splitter(20, 6, fixed.SPLIT_SEPARATORS)
    assert split("short") == ["short"]
    assert split("aaaa bbbb cccc dddd eeee ffff") == ["aaaa bbbb cccc dddd", "dddd eeee ffff"]
    assert split("one two. three four five. six") == ["one two", ". three four five", ". six"]
    assert split("x" * 45) == ["x" * 20, "x" * 20, "x" * 17]
    text = "\n".join("line %d with some words, and more" % i for i in range(30))
    parts = _make_recursive_splitter(100, 30, fixed.SPLIT_SEPARATORS)(text)
    assert max(map(len, parts)) <= 100 and all(p in text for p in parts)


PAGES = [("d", p, t) for p, t in [(1, "ab"), (3, "c"), (4, "defgh"), (9, "i"), (10, ""), (12, "jk"), (40, "lmnop")]] + [("e", 5, "zz")]


@pytest.mark.parametrize("block", [1, 4, 100])
def test_page_order_helpers(spark, block):
    df = spark.createDataFrame(PAGES, "doc_name string, page long, text string")
    seams = {(r["doc_name"], r["page"]): r["seam"] for r in ordering.page_seams(df, "text", 4, "|", block).collect()}
    assert seams == {("d", 3): "ab|c", ("d", 4): "ab|c|defg", ("d", 9): "efgh|i", ("d", 12): "gh|i|jk", ("d", 40): "i|jk|lmno"}
    for n in (1, 2, 3, 4, 9, 100):
        heads = {r["doc_name"]: r["head"] for r in ordering.doc_heads(df, "text", n, block).collect()}
        assert heads == {"d": "\n".join(t for d, _, t in PAGES if d == "d")[:n], "e": "zz"[:n]}
    index = ordering.dense_index(df, ["page"], "n", block=block).where("doc_name = 'd'").orderBy("page").collect()
    assert [r["n"] for r in index] == list(range(7))


def test_characters_one_by_one(spark):
    """The unprintable ones against the rule applied character by character."""
    import random
    import unicodedata

    def rule(text):
        text = unicodedata.normalize("NFKC", text)
        out, gap = [], False
        for x in text:
            if x in "\n\t " or not x.isspace():
                gap = False
                if x in "\n\t" or unicodedata.category(x)[0] != "C":
                    out.append(x)
            elif not gap:
                out.append(" ")
                gap = True
        return "".join(out)

    r = random.Random(1)
    pool = [*"ab \n\t", "\u2003", "\u3000", "\x1c", "\x85", "\u2028", "\u200e", "\x07", "\ue000", "\U000e0001", "ﷺ", "①", "\u0378"]
    texts = ["日" + "".join(r.choices(pool, k=12)) for _ in range(300)]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "i long, parts array<string>")
    got = {x.i: x.fixed[0] for x in df.select("i", clean.fix_unicode_parts(F.col("parts")).alias("fixed")).collect()}
    assert got == {i: rule(t) for i, t in enumerate(texts)}


def test_the_line_filter_moves_no_prose(spark):
    """Pages go through the Python step once, and only hits leave the page."""
    rows = [("d", i, f"Header of it all\nwords of page {i} — 日本 text that is long\nmore of {i}\nand {i}\nFooter of it all") for i in range(40)]
    pages = spark.createDataFrame(rows, "doc_name string, page long, text string")
    boilerplate = clean.header_footer_lines(pages)
    prepared = pages.select("doc_name", "page", F.array("text").alias("_prose"))
    plan = clean.unwanted_lines(prepared, boilerplate.select("doc_name", "line"))
    shuffled = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x]
    assert shuffled and all("_prose" not in x for x in shuffled)
    got = {x.page: sorted(x._unwanted) for x in plan.collect()}
    assert got == {i: ["Footer of it all", "Header of it all"] for i in range(40)}
    cleaned = clean.clean_pages(pages)
    text = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in text and cleaned.where("text LIKE '%of it all%'").count() == 0 and cleaned.count() == 40
    likely = pages.select("doc_name", F.explode(F.split("text", "\n")).alias("line")).join(F.broadcast(bitmaps.bitmap_filter(boilerplate, "doc_name", "line")))
    hit = likely.where(bitmaps.may_hold("doc_name", "line"))
    assert hit.where("line LIKE '%of it all'").count() == 80 and hit.count() < 90


def test_heads_move_only_head_pages(spark):
    """Of many pages, those behind the head never reach an exchange with their text."""
    rows = [(f"d{i % 3}", i * 10**6, f"page {i} " + "x" * 300) for i in range(600)]
    pages = spark.createDataFrame(rows, "doc_name string, page long, text string")
    heads = {r.doc_name: r.head for r in ordering.doc_heads(pages, "text", 700).collect()}
    for d in range(3):
        own = "\n".join(t for n, _, t in rows if n == f"d{d}")
        assert heads[f"d{d}"] == own[:700]
    wanted = ordering.head_pages(ordering.page_sizes(pages, "text"), 700)
    assert wanted.count() == 9 and bitmaps.filtered(pages, wanted, "doc_name", "page").count() < 15
    assert bitmaps.filtered(pages, wanted.limit(0), "doc_name", "page").count() == 0
    assert ordering.doc_heads(pages.limit(0), "text", 5).count() == 0
