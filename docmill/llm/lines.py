"""Line dedup by site-relative frequency.

Pages are grouped by host. A line that stands on at least ``ratio`` of the
host's pages, and on ``least`` pages or more, is boilerplate of that host and
dropped from all its pages. Exact copies of a page count once, else a page that
was crawled often would lose its own lines. With ``near_copies`` a group of
near-duplicates (``minhash``) counts once too, both
where a line stands and among all pages of the host.

Lines are compared without outer spaces, by a 64-bit hash within their host;
empty lines stay. Distinct pages are stored with the hashes of their lines, a row
each; counting runs on (host, line) with partial aggregation, so a hot host or line
is spread. The boilerplate of one host is
bounded (lines per page / ratio), so it travels as one array per host: broadcast
if the whole is small, else joined with salted hosts.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill.llm import minhash
from docmill.llm.names import fresh
from docmill.operators.bitmaps import bitmap_filter, may_hold
from docmill.session import cut_lineage

#: Most (host, line) rows that are broadcast; beyond, a join with salted hosts.
MOST_BROADCAST, SALTS = 200_000, 32


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), _key))


def pages_of(docs: DataFrame, host: Column, text: Column) -> DataFrame:
    """``host``, ``page`` (two hashes of the text) and ``lines`` (hashes) of every
    distinct page of a host. A page moves once, with its lines in one row."""
    return docs.select(
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text")
    ).where("text IS NOT NULL").select(
        "host", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b")).alias("page"),
        _lines(F.col("text")).alias("lines"),
    ).dropDuplicates(["host", "page"])


def boilerplate(pages: DataFrame, ratio: float = 0.02, least: int = 5) -> DataFrame:
    """``host``, ``line`` (hash), ``pages`` that hold it and ``total`` pages of the host,
    from the distinct pages (``pages_of``); store these first, they are read twice.

    A null host counts as the host ''; a null text is no page.
    """
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = (
        pages.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    )
    return counts.join(totals, "host").where(F.col("pages") >= F.lit(ratio) * F.col("total")).select("host", "line", "pages", "total")


def of_groups(found: DataFrame, pages: DataFrame, docs: DataFrame, host: Column, text: Column, ratio: float, least: int) -> DataFrame:
    """The lines ``found`` (host, line) that are boilerplate if a group of near copies
    counts as one page, among the pages (``pages_of``) and among all pages of the host.

    Lines that aren't among those found are dropped by a filter before they move."""
    own = docs.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("text")).where("text IS NOT NULL")
    own = own.withColumn("id", F.xxhash64("text")).join(found.select("host").distinct(), "host", "left_semi")
    groups = cut_lineage(minhash.near_duplicates(own.select("id", "text"), "id").select("id", "component").distinct())
    tested = pages.select("host", F.col("page.a").alias("id"), "lines").join(F.broadcast(bitmap_filter(found, "host", "line")))
    likely = tested.select("host", "id", F.filter("lines", lambda x: may_hold("host", x)).alias("lines"))
    # pages of hosts without a line found have no group
    grouped = cut_lineage(likely.join(groups, "id").select("host", "component", "lines"))
    totals = grouped.select("host", "component").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = (
        grouped.select("host", "component", F.explode("lines").alias("line")).distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
        .join(found.select("host", "line"), ["host", "line"], "left_semi")
    )
    return counts.join(totals, "host").where(F.col("pages") >= F.lit(ratio) * F.col("total")).select("host", "line", "pages", "total")


def without_boilerplate(docs: DataFrame, host: Column, text: str = "text", ratio: float = 0.02, least: int = 5,
                        dropped: str | None = None, near_copies: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines, all rows and columns kept.

    ``dropped`` names a further column with the number of lines taken from each
    text. A text without boilerplate stays as it is, null too; a text of
    nothing else becomes empty. Repeated rows are treated alike. With
    ``near_copies`` a group of near copies counts as one page.
    """
    pages = cut_lineage(pages_of(docs, host, F.col(f"`{text}`")))
    found = cut_lineage(boilerplate(pages, 0 if near_copies else ratio, least))
    if near_copies:
        found = cut_lineage(of_groups(found, pages, docs, host, F.col(f"`{text}`"), ratio, least))
    _host, _of, _bad, _kept, _salt, _s = fresh(docs, "host", "of", "bad", "kept", "salt", "s")
    by_host = found.groupBy(F.col("host").alias(_of)).agg(F.collect_set("line").alias(_bad))
    joined = docs.withColumn(_host, F.coalesce(host.cast("string"), F.lit("")))
    if found.count() <= MOST_BROADCAST:
        joined = joined.join(F.broadcast(by_host), F.col(_host) == F.col(_of), "left")
    else:
        salted = by_host.withColumn(_s, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = joined.withColumn(_salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, (F.col(_host) == F.col(_of)) & (F.col(_salt) == F.col(_s)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    bad = lambda x: (F.trim(x) != "") & F.array_contains(F.col(_bad), _key(x))
    # one pass over the lines: those to keep; texts of hosts without boilerplate aren't split at all
    kept = F.when(F.col(_bad).isNotNull() & F.col(f"`{text}`").isNotNull(), F.filter(lines, lambda x: ~bad(x)))
    joined = joined.withColumn(_kept, kept)
    gone = F.when(F.col(_kept).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(_kept)).cast("long")
    new = F.when(F.col(_kept).isNull() | (F.size(_kept) == F.size(lines)), F.col(f"`{text}`")).otherwise(F.array_join(_kept, "\n"))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() != (dropped or "").lower()]
    return joined.select(*columns, *([gone.alias(dropped)] if dropped else []))
