"""Queries over keys and counts that the small tables don't reach."""
import duckdb
import pytest

from docmill.checks.registry import QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", ["model_codes", "document_meta", "component_codes", "doc_id_prefixes"])
def test_parts_that_share_five_digits(spark, tmp_path, name):
    con = duckdb.connect()
    keys = [(7, 3), (12345, 3), (123450, 20), (123451, 5), (123452, 45), (1234567, 9), (99999, 44), (999990, 2), (999991, 1), (12345678, 2), (1234567890, 30)]
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT)")
    for brand in ("Brand#1", "Brand#2"):
        con.executemany("INSERT INTO part VALUES (?, 'n', ?, 't', ?)", [(k, brand, z) for k, z in keys if brand == "Brand#1" or k % 2])
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    query, sql = QUERIES[name]
    assert compare(spark, con, str(tmp_path), query, sql) is None
