"""Whole pages pass to a worker a few at once."""
from pyspark.sql import functions as F

from docmill.operators import classify


def test_a_worker_holds_few_pages(spark, monkeypatch):
    @F.pandas_udf("array<string>")
    def held(batch):
        return batch.map(lambda _: [str(len(batch))])

    monkeypatch.setattr(classify, "term_hits", lambda text, terms: held(text))
    pages = spark.range(0, 1000, 1, 1).selectExpr("'d' AS doc_name", "id AS page", "'some text' AS text")
    sizes = {int(r.hits[0]) for r in classify.page_evidence(pages, ["text"]).collect()}
    assert max(sizes) <= 256
