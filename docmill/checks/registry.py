"""All registered queries."""
from importlib import import_module

from pyspark.sql import functions as F

_MODULES = ["text", "category", "tables", "meta", "chunks", "store"]
QUERIES: dict = {}
for _name in _MODULES:
    QUERIES.update(import_module(f"docmill.checks.{_name}").QUERIES)


def flagship(spark, folder):
    """Distinct prose chunks per source after cleaning."""
    from docmill.checks.common import pages
    from docmill.operators.chunk import prose_chunks
    from docmill.operators.clean import clean_pages
    from docmill.operators.dedup import exact_dedup

    chunks = exact_dedup(prose_chunks(clean_pages(pages(spark, folder)), "window"))
    return chunks.groupBy("doc_name").agg(F.count(F.lit(1)).alias("chunks"))
