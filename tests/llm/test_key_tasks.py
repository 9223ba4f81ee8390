"""Tasks that make combined keys, however many documents a file holds."""
import pytest

pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from docmill.llm import minhash  # noqa: E402


def test_a_task_makes_a_bounded_number_of_combined_keys(spark, monkeypatch):
    docs, most = 400, 10_000
    monkeypatch.setattr(minhash, "KEYS_PER_TASK", most)
    ids = spark.range(docs).coalesce(1)
    unique = ids.select("id", F.expr(f"transform(sequence(1, {2 * minhash.TABLES * minhash.ROWS}), x -> int(x * id))").alias("signature"))
    own = ids.select("id", F.expr(f"transform(sequence(1, {minhash.TABLES}), x -> struct(int(x) AS t, x * 1000 + id AS a))").alias("own"))
    made = [r["count"] for r in minhash._combined(unique, own).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == docs * minhash.TABLES**2
    # some tasks get more documents than others
    assert max(made) < 3 * most
