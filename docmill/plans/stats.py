"""Group counts over stored chunks and per-document summaries."""
from pyspark.sql import Column, DataFrame, functions as F


def _text(name: str, columns: list[str]) -> Column:
    return F.col(name).cast("string") if name in columns else F.lit(None).cast("string")


def model_combo(columns: list[str]) -> Column:
    """Vendor with model, else component, else family, else category."""
    def text(name):
        return F.nullif(_text(name, columns), F.lit(""))

    vendor = F.coalesce(_text("vendor", columns), F.lit("UNKNOWN"))
    return F.coalesce(
        F.concat(vendor, F.lit(" "), text("model")),
        F.concat(vendor, F.lit(" component "), text("component")),
        F.concat(vendor, F.lit(" "), text("family" if "family" in columns else "product_family")),
        F.concat(vendor, F.lit(" "), F.coalesce(_text("category", columns), F.lit("UNKNOWN"))),
    )


_DIMENSIONS = ("by_category", "by_vendor", "by_chunk_type", "by_model_combo")


def combinations(chunks: DataFrame) -> DataFrame:
    """``n`` chunks of every combination of category, vendor, chunk type and model
    combo. Such counts of parts of a collection add up. A column that isn't there
    counts as unknown."""
    known = [F.coalesce(_text(c, chunks.columns), F.lit("UNKNOWN")) for c in ("category", "vendor", "chunk_type")]
    return chunks.groupBy(*[value.alias(name) for name, value in zip(_DIMENSIONS, [*known, model_combo(chunks.columns)])]).agg(
        F.count(F.lit(1)).alias("n")
    )


def labelled(combined: DataFrame) -> DataFrame:
    """(dimension, value, n) from counts of combinations, with a total."""
    labels = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value")) for name in _DIMENSIONS
    ], F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    # an empty collection has a total too
    nothing = combined.sparkSession.range(1).select(F.lit("total").alias("dimension"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"))
    return (
        combined.select(F.explode(labels).alias("l"), "n").select("l.*", "n").unionByName(nothing)
        .groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    )


def collection_stats(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n) for category, vendor, chunk type, model combo, total.

    One pass over the chunks counts the combinations of all four; only those few
    rows expand to their labels."""
    return labelled(combinations(chunks))


def stats_report(chunks: DataFrame) -> DataFrame:
    return collection_stats(chunks).orderBy("dimension", "value")


def write_report(stats: DataFrame, path: str) -> None:
    """(dimension, value, n) as a table sorted by both, in place of an older one."""
    stats.orderBy("dimension", "value").write.mode("overwrite").parquet(path)


def chunk_type_counts(chunks: DataFrame, missing: str = "un-tagged") -> DataFrame:
    return chunks.groupBy(F.coalesce("chunk_type", F.lit(missing)).alias("chunk_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, OCR pages, pages with tables."""
    return pages.groupBy("doc_name").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("ocr_used").alias("ocr_pages"),
        F.count_if("has_tables").alias("table_pages"),
    )


def samples(chunks: DataFrame, kind: str, n: int, preview: int) -> DataFrame:
    """The first ``n`` chunks of a type by id, with a text preview."""
    return (
        chunks.where(F.col("chunk_type") == kind).orderBy("chunk_id").limit(n)
        .withColumn("text", F.left("text", F.lit(preview)))
    )
