"""Document sources: PDF folders and ready-made page tables.

A decoder turns file bytes into page *elements* (text blocks, tables, OCR
tokens) and is the only native code. What becomes of the elements is decided
by column expressions.
"""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill import fixed
from docmill.functions.stage import computed
from docmill.functions.text import basename, collapse_ws, let, strip

BOX = "x0:double,y0:double,x1:double,y1:double"
TOKENS = "array<struct<text:string,conf:double>>"
ELEMENTS = (
    "doc_path string, page bigint, "
    f"blocks array<struct<{BOX},text:string>>, plain string, "
    f"tables array<struct<{BOX},headers:array<string>,rows:array<array<string>>>>, "
    f"ocr {TOKENS}, logo {TOKENS}, error string"
)


#: Rows of a task, when rows are spread.
SPREAD_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work even tasks. A file's row groups can't be divided, so of
    many splits a few may hold all rows; a count by task, of no columns, tells."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        held = [df.count()]
    else:
        held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("_part")).count().collect()]
    total = sum(held)
    if len(held) >= cores and max(held) * cores <= 2 * total:
        return df
    return df.repartition(max(cores, total // SPREAD_ROWS))


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files directly in ``folder``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def pymupdf_decoder(dpi: int = fixed.OCR_DPI, threshold: int = fixed.OCR_CHAR_THRESHOLD):
    """Decoder over PyMuPDF, with PaddleOCR for pages almost without text.

    Both packages are optional. Without the first every file reports an error;
    without the second image pages stay empty.
    """
    state: dict = {}

    def reader():
        if "ocr" not in state:
            try:
                from paddleocr import PaddleOCR

                state["ocr"] = PaddleOCR(use_angle_cls=True, lang="en")
            except ImportError:
                state["ocr"] = None
        return state["ocr"]

    def tokens(fitz, page, clip=None):
        if reader() is None:
            return []
        import numpy as np

        try:
            pixels = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), clip=clip, colorspace=fitz.csRGB)
            image = np.frombuffer(pixels.samples, np.uint8).reshape(pixels.h, pixels.w, 3)
            found = reader().ocr(image, cls=True)
            return [{"text": t[1][0], "conf": float(t[1][1])} for t in (found[0] if found and found[0] else [])]
        except Exception:
            return []

    def tables(page):
        out = []
        try:
            for table in page.find_tables().tables:
                frame = table.to_pandas()
                if not frame.empty:
                    out.append({
                        **dict(zip(("x0", "y0", "x1", "y1"), map(float, table.bbox))),
                        "headers": [None if h is None else str(h) for h in frame.columns],
                        "rows": [[None if c is None else str(c) for c in r] for r in frame.values.tolist()],
                    })
        except Exception:
            pass  # keep the tables found so far
        return out

    def decode(content: bytes):
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            for number, page in enumerate(doc, 1):
                found = tables(page)
                boxes = [fitz.Rect(t["x0"], t["y0"], t["x1"], t["y1"]) for t in found]
                blocks = page.get_text("blocks") if found else []
                plain = None if found else page.get_text("text")
                visible = plain if plain is not None else "".join(
                    b[4] for b in blocks if not any(fitz.Rect(b[:4]).intersects(x) for x in boxes)
                )
                top = fitz.Rect(0, 0, page.rect.width, page.rect.height * 0.30)
                yield {
                    "page": number,
                    "blocks": [
                        {**dict(zip(("x0", "y0", "x1", "y1"), map(float, b[:4]))), "text": b[4]} for b in blocks
                    ],
                    "plain": plain,
                    "tables": found,
                    "ocr": tokens(fitz, page) if len(visible.strip()) < threshold else [],
                    "logo": tokens(fitz, page, top) if number == 1 else [],
                }

    return decode


def decode_files(files: DataFrame, decoder=None) -> DataFrame:
    """Page elements of (path, content); a file that fails gives one error row."""
    decode = decoder or pymupdf_decoder()
    columns = ["doc_path", "page", "blocks", "plain", "tables", "ocr", "logo", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"doc_path": path, "error": None, **p} for p in decode(bytes(content))]
                    rows = rows or [{"doc_path": path, "error": None}]
                except Exception as failure:
                    rows = [{"doc_path": path, "error": str(failure) or type(failure).__name__}]
                yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    return files.mapInPandas(run, ELEMENTS)


# --- assembling a page from its elements -------------------------------------

def overlaps(a, b) -> Column:
    """Rectangles share an area; touching edges do not count."""
    return (
        (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"]))
        & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))
    )


def table_markdown(headers, rows) -> Column:
    def row(cells):
        return F.array_join(F.transform(cells, lambda c: F.coalesce(strip(collapse_ws(c)), F.lit(""))), " | ")

    rule = F.array_join(F.array_repeat(F.lit("---"), F.size(headers)), " | ")
    return F.array_join(F.concat(F.array(row(headers), rule), F.transform(rows, row)), "\n")


def ocr_text(tokens, keep_blank: bool = False) -> Column:
    """Confident tokens joined by a space."""
    sure = F.filter(
        tokens,
        lambda t: (t["conf"] > fixed.OCR_MIN_CONFIDENCE) & (F.lit(keep_blank) | (strip(t["text"]) != "")),
    )
    return F.array_join(F.transform(sure, lambda t: t["text"]), " ")


def unmasked_text(blocks, tables) -> Column:
    """Texts of the blocks that overlap no table, one per line."""
    free = F.filter(blocks, lambda b: ~F.exists(tables, lambda t: overlaps(b, t)))
    return F.array_join(F.transform(free, lambda b: b["text"]), "\n")


def page_text(raw, tables_md) -> Column:
    """Text, blank line, one marker and all tables."""
    marked = F.when(tables_md != "", F.concat(F.lit(fixed.TABLE_MARKER + "\n"), tables_md))
    return F.concat_ws("\n\n", F.nullif(raw, F.lit("")), marked)


def with_ocr_fallback(text, ocr) -> Column:
    """Struct(text, ocr_used): OCR replaces text under the threshold, if it found any."""
    return let(
        F.struct(text.alias("t"), F.coalesce(ocr, F.lit("")).alias("o")),
        lambda s: let(
            (F.length(strip(s["t"])) < fixed.OCR_CHAR_THRESHOLD) & (s["o"] != ""),
            lambda use: F.struct(F.when(use, s["o"]).otherwise(s["t"]).alias("text"), use.alias("ocr_used")),
        ),
    )


def assemble_pages(elements: DataFrame) -> DataFrame:
    """Raw pages of decoded elements; pages without any text are left out."""
    markdown = F.array_join(F.transform("tables", lambda t: table_markdown(t["headers"], t["rows"])), "\n\n")
    has_tables = F.coalesce(F.size("tables") > 0, F.lit(False))
    raw = strip(F.when(has_tables, unmasked_text(F.col("blocks"), F.col("tables"))).otherwise(F.coalesce("plain", F.lit(""))))
    good = elements.where(F.col("error").isNull() & F.col("page").isNotNull())
    text = page_text(raw, F.when(has_tables, markdown).otherwise(""))
    return (
        computed(good, _p=with_ocr_fallback(text, ocr_text(F.col("ocr"))))
        .select(
            basename(F.col("doc_path")).alias("doc_name"), "doc_path", "page",
            F.col("_p.text").alias("text"), has_tables.alias("has_tables"),
            F.col("_p.ocr_used").alias("ocr_used"),
            F.coalesce(ocr_text(F.col("logo"), keep_blank=True), F.lit("")).alias("logo_text"),
        )
        .where(strip(F.col("text")) != "")
    )


def pages_table(df: DataFrame, doc_name, page, text) -> DataFrame:
    """Raw pages from any table that already holds page texts."""
    return df.select(
        doc_name.alias("doc_name"), doc_name.alias("doc_path"), page.cast("bigint").alias("page"), text.alias("text"),
        F.contains(text, F.lit(fixed.TABLE_MARKER)).alias("has_tables"),
        F.lit(False).alias("ocr_used"), F.lit("").alias("logo_text"),
    ).where(strip(F.col("text")) != "")
