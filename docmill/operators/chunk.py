"""From cleaned pages to chunks: prose splits, whole tables, spec rows."""
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill import fixed
from docmill.functions.text import chunk_id, let, strip
from docmill.operators.dedup import exact_dedup, near_dedup
from docmill.operators.ordering import dense_index
from docmill.operators.tables import attach_page_models, known_models, table_specs
from docmill.session import cut_lineage

CHUNK_COLUMNS = [
    "chunk_id", "chunk_type", "vendor", "family", "product_family", "display_family", "model", "component",
    "category", "doc_name", "source_document", "page", "chunk_idx", "has_table", "text",
    "metric", "value", "spec_name", "spec_value",
]
_BLOCK = r"(?s)\[TABLE\].*?\[/TABLE\]"


def segments(text) -> Column:
    """Array of (text, is_table): stripped, in order, blanks removed."""
    tables = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))
    parts = let(
        F.struct(F.split(text, _BLOCK, -1).alias("p"), tables.alias("t")),
        lambda s: F.flatten(F.transform(s["p"], lambda p, i: F.array(p, F.get(s["t"], i)))),
    )
    stripped = F.filter(F.transform(parts, strip), lambda s: s.isNotNull() & (s != ""))
    return F.transform(
        stripped,
        lambda s: F.struct(s.alias("text"), F.startswith(s, F.lit(fixed.TABLE_OPEN)).alias("is_table")),
    )


def window_split(text, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Overlapping fixed windows, stripped, blanks removed."""
    step = size - overlap
    return let(strip(text), lambda t: let(
        F.greatest(F.ceil((F.length(t) - size) / step), F.lit(0)).cast("int"),
        lambda n: F.filter(
            F.transform(F.sequence(F.lit(0), n), lambda i: strip(t.substr(i * step + 1, F.lit(size)))),
            lambda w: w != "",
        ),
    ))


def _make_recursive_splitter(size: int, overlap: int, separators: list):
    def pieces(text, sep):
        """Cut before every separator, so each piece but the first starts with one."""
        if sep == "":
            return list(text)
        head, *rest = text.split(sep)
        return [p for p in [head, *(sep + r for r in rest)] if p]

    def pack(parts):
        """Join parts up to ``size``; start the next chunk with up to ``overlap``."""
        window, total = deque(), 0
        for part in parts:
            if window and total + len(part) > size:
                yield "".join(window)
                while window and (total > overlap or total + len(part) > size):
                    total -= len(window.popleft())
            window.append(part)
            total += len(part)
        if window:
            yield "".join(window)

    def split(text, seps):
        at = next(i for i, s in enumerate(seps) if s in text)
        small = []
        for part in pieces(text, seps[at]):
            if len(part) < size:
                small.append(part)
                continue
            yield from pack(small)
            small = []
            if at + 1 < len(seps):
                yield from split(part, seps[at + 1:])
            else:
                yield part
        yield from pack(small)

    def run(text):
        return [c for c in (chunk.strip() for chunk in split(text, separators)) if c]

    return run


def recursive_split(text, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Split at the coarsest separator that fits. Short texts stay in the JVM."""
    run = _make_recursive_splitter(size, overlap, list(fixed.SPLIT_SEPARATORS))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def long_texts(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else run(t))

    whole = F.filter(F.array(strip(text)), lambda t: t != "")
    return F.coalesce(long_texts(F.when(F.length(text) > size, text)), whole)


SPLITTERS = {"recursive": recursive_split, "window": window_split}


def explode_segments(pages: DataFrame) -> DataFrame:
    """(doc_name, page, seg, text, is_table)."""
    return pages.select("doc_name", "page", F.posexplode(segments(F.col("text"))).alias("seg", "s")).select(
        "doc_name", "page", "seg", "s.*"
    )


def prose_chunks(pages: DataFrame, splitter: str = "recursive") -> DataFrame:
    """(doc_name, page, seg, split, text) of at least the minimum length."""
    prose = explode_segments(pages).where(~F.col("is_table"))
    return (
        prose.select("doc_name", "page", "seg", F.posexplode(SPLITTERS[splitter](F.col("text"))).alias("split", "text"))
        .withColumn("text", strip(F.col("text")))
        .where(F.length("text") >= fixed.MIN_CHUNK_CHARS)
    )


def page_tables(pages: DataFrame) -> DataFrame:
    """(doc_name, page, seg, text, page_text) of every table segment."""
    parts = F.filter(
        F.transform(segments(F.col("text")), lambda s, i: F.struct(i.alias("seg"), s["text"].alias("t"), s["is_table"].alias("b"))),
        lambda s: s["b"],
    )
    return pages.where(F.contains("text", F.lit(fixed.TABLE_OPEN))).select(
        "doc_name", "page", F.col("text").alias("page_text"), F.explode(parts).alias("s")
    ).select("doc_name", "page", "s.seg", F.col("s.t").alias("text"), "page_text")


def document_models(doc_meta: DataFrame) -> DataFrame:
    """(doc_name, model) of the deployable models."""
    have = set(doc_meta.columns)
    none = F.array().cast("array<string>")
    optional = [F.coalesce(c, none) if c in have else none for c in ("components", "family_identifiers")]
    return doc_meta.select("doc_name", F.explode(known_models(F.col("models"), *optional)).alias("model"))


def with_base_meta(doc_meta: DataFrame) -> DataFrame:
    """Fill family from product_family and the other way round; "" if missing."""
    have = doc_meta.columns

    def first_of(*names):
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(""))

    return doc_meta.select(
        "doc_name", "vendor", "category",
        first_of("family", "product_family").alias("family"),
        first_of("product_family", "family").alias("product_family"),
        first_of("display_family", "family", "product_family").alias("display_family"),
    )


def spec_text(vendor, family, model, name, value, context) -> Column:
    return F.concat(
        F.lit("Vendor: "), vendor, F.lit("\nFamily: "), family, F.lit("\nModel: "), model,
        F.lit("\n\nFeature: "), name, F.lit("\nValue: "), value, F.lit("\n\nContext: "), context,
    )


def chunk_pages(
    pages: DataFrame, doc_meta: DataFrame, splitter: str = "recursive", models: DataFrame | None = None,
    preserve_thousands: bool = False, keep_edge_cells: bool = False,
) -> DataFrame:
    """All chunks of (doc_name, page, text) pages, numbered per document.

    Per document: near-deduplicated prose in page order, then per table the whole
    table followed by its spec rows. ``models`` is (doc_name, model); by default
    it comes from ``doc_meta.models``.
    """
    models = document_models(doc_meta) if models is None else models
    prose = near_dedup(exact_dedup(prose_chunks(pages, splitter)))
    tables = table_specs(attach_page_models(page_tables(pages), models), preserve_thousands, keep_edge_cells)
    spec_type = "struct<model:string,spec_name:string,value:string>"
    # numbering reads these rows twice
    tables = cut_lineage(tables.select("doc_name", "page", "seg", "text", "specs"))
    rows = tables.select(
        "doc_name", "page", "seg", "text",
        F.posexplode(F.concat(F.array(F.lit(None).cast(spec_type)), "specs")).alias("sub", "spec"),
    )
    ordered = prose.select(
        "doc_name", "page", "seg", F.col("split").alias("sub"), F.lit(0).alias("phase"), "text",
        F.lit(None).cast(spec_type).alias("spec"),
    ).unionByName(
        # the text stays with the table's own row; its spec rows don't carry copies of it
        rows.withColumn("phase", F.lit(1)).withColumn("text", F.when(F.col("spec").isNull(), F.col("text")))
    )
    numbered = dense_index(ordered, ["page", "seg", "sub"], "chunk_idx", lead="phase")
    full = numbered.join(with_base_meta(doc_meta), "doc_name")
    is_spec = F.col("spec").isNotNull()
    context = strip(F.concat_ws(" ", "vendor", "family", "category", F.lit("technical specification")))
    text = F.when(
        is_spec, spec_text(F.col("vendor"), F.col("family"), F.col("spec.model"), F.col("spec.spec_name"), F.col("spec.value"), context)
    ).otherwise(F.col("text"))
    kind = F.when(is_spec, "spec_row").when(F.col("phase") == 1, "table_full").otherwise("semantic")
    return (
        full.withColumn("text", text)
        .withColumns({
            "chunk_id": chunk_id(F.col("doc_name"), F.col("page"), F.col("text")),
            "chunk_type": kind,
            "model": F.coalesce("spec.model", F.lit("")),
            "component": F.lit(""),
            "source_document": F.col("doc_name"),
            "has_table": F.col("phase") == 1,
            "metric": F.col("spec.spec_name"),
            "value": F.col("spec.value"),
            "spec_name": F.col("spec.spec_name"),
            "spec_value": F.col("spec.value"),
        })
        .select(*CHUNK_COLUMNS)
    )
