"""From raw documents to token ids: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. ``run`` writes each stage's rows as a table and reads them for the next.
"""
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import decontaminate, lines, minhash, pieces, quality, queries
from docmill.llm.names import fresh
from docmill.session import cut_lineage, session_setting

#: A document of lower probability of good quality goes.
LEAST_QUALITY = 0.3

#: Whole texts that pass between Spark and a worker at once.
ROWS_PER_BATCH = "1024"

#: No SQL can express a trained network or a piece search.
ORACLE_SQL = None


def in_small_batches(stage):
    """A stage whose texts pass to Python a few at once: executor and worker both hold a batch.

    Spark looks the setting up when rows are made, so they are made and stored here.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with session_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH):
            return cut_lineage(stage(spark, docs, sf_dir))

    return run


@in_small_batches
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (name,) = fresh(docs, "score")
    scored = quality.score(docs, queries.quality_model(docs, labels), name=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; all documents stay.

    Near copies, which the next stage takes out, don't make each other's lines boilerplate.
    """
    return _counted(lines.without_boilerplate(docs, F.col("source"), near_copies=True), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


@in_small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.without_spans(docs, items), docs)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, with the number of ids, and whether decoding gives the text."""
    coded = pieces.round_trip(docs.select("doc_id", "source", "text"), queries.piece_model())
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars`` of the new text, where there is such a column."""
    return changed.select(*[
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns
    ])


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if not hasattr(stage, "__wrapped__"):  # else stored already
            docs = cut_lineage(docs)
    return docs
