"""Order-dependent operations inside a document, without a task per document.

One document may hold a large part of all pages. Everything here works on
blocks of neighbouring pages, ``(doc_name, page div BLOCK)``, and carries a
small summary from block to block, so that no task ever sorts a whole document.
Pages are numbered once per document, so a block has at most ``BLOCK`` pages.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from docmill.operators.bitmaps import filtered
from docmill.session import cut_lineage

DOC, PAGE, BLOCK = "doc_name", "page", 4096


def page_block(size: int = BLOCK) -> Column:
    return F.expr(f"{PAGE} div {int(size)}")


def _text_before(rows: DataFrame, keys: list, order: str, chars: int, sep: str, last, size) -> DataFrame:
    """Add ``_before``: the end of the ``_tail`` texts that precede each row,
    joined by ``sep`` and cut by ``last`` to ``chars`` in ``size``; "" on the first row.

    Tails are cut too. One of that size hides everything before it, so a row
    looks back to the last such tail and the short ones behind it.
    """
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    full = size(F.col("_tail")) >= chars
    rows = rows.withColumn("_full", F.last(F.when(full, F.col("_tail")), ignorenulls=True).over(earlier)).withColumn(
        "_run", F.coalesce(F.sum(full.cast("long")).over(earlier), F.lit(0))
    )
    # every short tail adds at least one to the size
    short = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(-(chars + 1), -1)
    behind = F.collect_list("_tail").over(short)
    joined = F.array_join(F.concat(F.filter(F.array("_full"), lambda t: t.isNotNull()), behind), sep)
    return rows.withColumn("_before", last(joined)).drop("_full", "_run")


def page_seams(pages: DataFrame, text: str, chars: int, sep: str, block: int = BLOCK) -> DataFrame:
    """(doc_name, page, seam): the last ``chars`` characters before each page,
    ``sep``, and the page's first ``chars``. A match that no single page holds
    lies across one of these seams. Pages with empty text do not count."""
    slim = pages.where(F.length(text) > 0).select(
        DOC, PAGE, F.left(text, F.lit(chars)).alias("_head"), F.right(text, F.lit(chars)).alias("_tail")
    )
    return seams_of(slim, chars, sep, block)


def seams_of(slim: DataFrame, chars: int, sep: str, block: int = BLOCK, last=None, size=F.length) -> DataFrame:
    """Seams from (doc_name, page, _head, _tail) of the pages with text. ``last``
    cuts a text to its end of ``chars`` in ``size``; by default, characters."""
    last = last or (lambda c: F.right(c, F.lit(chars)))

    def joined(*parts):
        return last(F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts]))

    rows = _text_before(slim.withColumn("_blk", page_block(block)), [DOC, "_blk"], PAGE, chars, sep, last, size)
    ends = rows.groupBy(DOC, "_blk").agg(F.max_by(joined(F.col("_before"), F.col("_tail")), PAGE).alias("_tail"))
    carried = _text_before(ends, [DOC], "_blk", chars, sep, last, size).select(DOC, "_blk", F.col("_before").alias("_carry"))
    before = joined(F.col("_carry"), F.col("_before"))
    return (
        rows.join(carried, [DOC, "_blk"]).where((F.col("_carry") != "") | (F.col("_before") != ""))
        .select(DOC, PAGE, F.concat(before, F.lit(sep), F.col("_head")).alias("seam"))
    )


def page_sizes(pages: DataFrame, text: str) -> DataFrame:
    """(doc_name, page, n_chars)."""
    return pages.select(DOC, PAGE, F.length(text).alias("n_chars"))


def head_pages(sizes: DataFrame, chars: int, block: int = BLOCK) -> DataFrame:
    """(doc_name, page) of the pages that reach into a document's first ``chars``.

    A page that starts exactly there still brings its separator."""
    sizes = sizes.select(DOC, PAGE, page_block(block).alias("_blk"), (F.col("n_chars") + 1).cast("long").alias("_n"))
    inside = Window.partitionBy(DOC, "_blk").orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(DOC).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    near = sizes.withColumn("_before", before).where(F.col("_before") <= chars)
    starts = (
        sizes.groupBy(DOC, "_blk").agg(F.sum("_n").alias("_n"))
        .select(DOC, "_blk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_start"))
        .where(F.col("_start") <= chars)
    )
    return (
        near.join(starts, [DOC, "_blk"])
        .where(F.col("_start") + F.col("_before") <= chars)
        .select(DOC, PAGE)
    )


def join_pages(text: str, where: Column | None = None, sep: str = "\n") -> Column:
    """Aggregate: page texts in page order. Only for a bounded set of pages."""
    page = F.struct(PAGE, F.col(text).alias("t"))
    chosen = F.collect_list(page if where is None else F.when(where, page))
    return F.array_join(F.transform(F.array_sort(chosen), lambda p: p["t"]), sep)


def doc_heads(
    pages: DataFrame, text: str, chars: int, block: int = BLOCK, sizes: DataFrame | None = None
) -> DataFrame:
    """(doc_name, head): the first ``chars`` characters of the joined pages.

    The head pages are found by their sizes; a filter on them lets only their texts
    (and a few others) reach the join."""
    sizes = page_sizes(pages, text) if sizes is None else sizes
    heads = cut_lineage(head_pages(sizes, chars, block))
    return (
        filtered(pages.select(DOC, PAGE, text), heads, DOC, PAGE)
        .select(DOC, PAGE, F.left(text, F.lit(chars)).alias("_t"))
        .join(heads, [DOC, PAGE])
        .groupBy(DOC)
        .agg(F.left(join_pages("_t"), F.lit(chars)).alias("head"))
    )


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """(doc_name, page) of the first ``n`` pages; ranks are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(DOC).orderBy(PAGE))
    return pages.select(DOC, PAGE).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def dense_index(df: DataFrame, order: list, name: str, lead: str | None = None, block: int = BLOCK) -> DataFrame:
    """Number rows per document from 0 in ``order``.

    ``lead`` is an optional column that sorts before the page. Row numbers run
    inside (lead, page block); a running sum over block sizes gives the offsets.
    ``df`` is evaluated twice, so store it first if it is costly.
    """
    keys = [DOC] + ([lead] if lead else []) + ["_blk"]
    rows = df.withColumn("_blk", page_block(block)).withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    )
    across = Window.partitionBy(DOC).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_start")
    )
    return (
        rows.join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_blk", "_pos", "_start")
    )
