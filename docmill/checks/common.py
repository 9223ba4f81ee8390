"""Inputs shared by the queries: documents seen as pages, and SQL fragments."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill import fixed
from docmill.sources.documents import pages_table, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one source are the pages of one file."""
    return pages_table(
        documents(spark, folder), F.concat("source", F.lit(".pdf")), F.col("doc_id"), F.col("text")
    )


def text_map(change):
    """Query over documents: doc_id and a changed text."""
    def run(spark, folder):
        return documents(spark, folder).select("doc_id", change(F.col("text")).alias("text"))
    return run


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS_SQL = sql_text(fixed.WS_CHARS)
# RE2 classes that equal the Unicode ones
WS_RE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD_RE = r"\p{L}\p{N}_"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def lines_sql(x: str) -> str:
    return f"string_split({x}, chr(10))"


def values_sql(items) -> str:
    return "(" + ", ".join(sql_text(i) for i in items) + ")"


def collapse_sql(x: str) -> str:
    return f"regexp_replace({x}, '[{WS_RE}]+', ' ', 'g')"


def label_sql(x: str) -> str:
    return f"trim(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g'))"


PAGES_SQL = f"""pages AS (
  SELECT source || '.pdf' AS doc_name, doc_id AS page, text FROM documents WHERE {strip_sql('text')} <> '')"""


def lit_array(*items) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])
