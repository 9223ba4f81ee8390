"""Rows of a file whose row groups can't be divided."""
import pytest
from pyspark.sql import functions as F

from docmill.checks import meta, tables
from docmill.sources.documents import spread


def _most(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_splits_without_rows_do_not_count(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 4000, 1, cores).where("id < 500")
    assert rows.rdd.getNumPartitions() == cores and _most(spread(rows)) < 2 / cores
    even = spark.range(0, 4000, 1, cores)
    assert spread(even) is even
    assert spread(even.limit(0)).count() == 0


@pytest.mark.parametrize("query", [tables.label_predicates, meta.product_family, meta.filename_metadata, meta.vendor_pages])
def test_one_row_group_keeps_all_cores_busy(spark, query):
    assert _most(query(spark, "/root/testdata/sf0.01")) < 0.3
