"""Corpus ingest: raw pages to chunks, vectors and a per-document report."""
import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from docmill.operators.chunk import chunk_pages
from docmill.operators.classify import detect_category
from docmill.operators.clean import clean_pages
from docmill.operators.meta import doc_meta_relations, with_code_lists
from docmill.plans.stats import page_summary, write_report
from docmill.session import cut_lineage, session_setting
from docmill.sources.documents import assemble_pages, decode_files, scan_directory, spread
from docmill.sources.embedders import model_embedding
from docmill.sources.store import VectorStore

FILES_PER_BATCH = "8"
#: Lines of the statistics in the log; the report's table has all.
MOST_LOGGED = 200
log = logging.getLogger("docmill")


def with_display_family(meta: DataFrame) -> DataFrame:
    """A document without models is shown under its category."""
    return meta.withColumn(
        "display_family", F.when(F.size("models") == 0, F.col("category")).otherwise(F.col("product_family"))
    )


def document_meta(
    raw: DataFrame, clean: DataFrame, filename: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Metadata from raw pages with the category from cleaned ones, one row per
    document, and the relation (doc_name, model)."""
    parts = doc_meta_relations(raw, filename)
    parts["models"] = cut_lineage(parts["models"])
    meta = with_code_lists(parts).join(
        detect_category(clean, filename=filename).select("doc_name", "category", "confidence"), "doc_name"
    )
    return cut_lineage(with_display_family(meta)), parts["models"]


def build_chunks(raw: DataFrame, splitter: str = "recursive", filename: Column | None = None, **options):
    """(chunks, meta, clean) of raw pages. Intermediate results that several
    steps read are checkpointed, so a lost executor repeats little."""
    clean = cut_lineage(clean_pages(raw))
    meta, models = document_meta(raw, clean, filename)
    return chunk_pages(clean, meta, splitter, models=models, **options), meta, clean


def ingest_report(
    raw: DataFrame, clean: DataFrame, meta: DataFrame, chunks: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """One row per file with status and counts; failed files keep their error."""
    made = chunks.groupBy("doc_name").agg(F.count(F.lit(1)).alias("chunks"))
    left = clean.groupBy("doc_name").agg(F.count(F.lit(1)).alias("_clean"))
    files = page_summary(raw).select("doc_name", "pages", "ocr_pages", F.lit(None).cast("string").alias("_error"))
    if failures is not None:
        lost = failures.select(
            "doc_name", F.lit(0).cast("bigint").alias("pages"), F.lit(0).cast("bigint").alias("ocr_pages"),
            F.coalesce("error", F.lit("No text extracted.")).alias("_error"),
        )
        files = files.unionByName(lost)
    error = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("_clean").isNull(), "All pages empty.")
        .when(F.col("chunks").isNull(), "No chunks produced.")
    )
    return (
        files.join(left, "doc_name", "left").join(made, "doc_name", "left")
        .join(meta.select("doc_name", "category", "vendor", "models"), "doc_name", "left")
        .select(
            F.col("doc_name").alias("file"),
            F.when(error.isNull(), "success").otherwise("failed").alias("status"),
            "category", "vendor",
            F.coalesce("models", F.array().cast("array<string>")).alias("models"),
            "pages",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("chunks", F.lit(0)).alias("vectors"),
            "ocr_pages",
            error.alias("error"),
        )
    )


def ingest_pages(
    raw: DataFrame, store: VectorStore, embed=model_embedding, failures: DataFrame | None = None,
    splitter: str = "recursive", replace_documents: bool = False, **options,
) -> DataFrame:
    """Chunk, embed and upsert raw pages; returns the report."""
    chunks, meta, clean = build_chunks(raw, splitter, **options)
    # counted as they are written
    made = Observation()
    kinds = ("semantic", "table_full", "spec_row")
    chunks = cut_lineage(chunks.observe(made, F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("chunk_type") == k).alias(k) for k in kinds]))
    log.info("chunks: %d (%s)", made.get["all"], ", ".join(f"{k} {made.get[k]}" for k in kinds))
    # chunks come grouped by document; embedding cost follows rows
    vectors = chunks.repartition(max(chunks.rdd.getNumPartitions(), raw.sparkSession.sparkContext.defaultParallelism))
    store.upsert(vectors.withColumn("embedding", embed(F.col("text"))), replace_documents)
    return ingest_report(raw, clean, meta, chunks, failures)


def ingest_directory(
    spark: SparkSession, folder: str, store_path: str, reset: bool = False, decoder=None, embed=model_embedding,
    **options,
) -> DataFrame:
    """Ingest every PDF of a folder. A file that fails is reported, not raised."""
    store = VectorStore(spark, store_path)
    if reset:
        store.reset()
    # files are large: hand them to the decoder a few at a time
    with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", FILES_PER_BATCH):
        elements = cut_lineage(decode_files(spread(scan_directory(spark, folder)), decoder))
    raw = cut_lineage(assemble_pages(elements))
    names = elements.select(F.regexp_extract("doc_path", r"([^/]*)$", 1).alias("doc_name"), "error")
    failures = names.groupBy("doc_name").agg(F.max("error").alias("error")).join(
        raw.select("doc_name").distinct(), "doc_name", "left_anti"
    )
    report = ingest_pages(raw, store, embed, failures, **options)
    log.info("vectors: %d", store.count())
    write_report(store.stats(), f"{store.path}/report")
    for row in spark.read.parquet(f"{store.path}/report").orderBy("dimension", "value").limit(MOST_LOGGED).collect():
        log.info("%s %s: %d", row["dimension"], row["value"], row["n"])
    return report
