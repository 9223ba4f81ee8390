"""Matches across page borders, repeated questions, the store's pointer and empty statistics."""
import pytest

from docmill.operators import meta
from docmill.plans import retrieval, stats
from docmill.sources.store import VectorStore


@pytest.mark.parametrize("gap", [0, 1, 10, 140, 5000])
def test_matches_across_a_page_border(spark, gap):
    first = "x " * 300 + "© 2024 Bolt Works," + " " * gap
    rows = [("d", 1, first), ("d", 2, " " * gap + "Inc. and more BIG-IP"), ("d", 3, " \n "), ("d", 4, " " * gap + "i5800 rest")]
    facts = meta.page_facts(spark.createDataFrame(rows, "doc_name string, page long, text string"))
    seams = meta.fact_seams(facts)
    heads = facts.selectExpr("doc_name", "'' AS head").distinct()
    assert "Bolt Works" in {r.name for r in meta.vendor_candidates(facts, heads, seams).collect()}
    codes = {" ".join(r.code.split()) for r in meta.code_counts(facts, seams).collect()}
    assert codes == {"BIG-IP i5800"}


def test_repeated_questions_get_whole_answers(spark):
    vectors = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate("abcdef")], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [0.0, 1.0]), ("q", [0.0, 1.0]), ("p", [1.0, 0.0])], "query_id string, embedding array<double>")
    for size in (512, 2):
        retrieval.QUERY_BATCH = size
        got = retrieval.top_k(vectors, asked, 3).collect()
        assert sorted((r.query_id, r.rank, r.id) for r in got) == sorted(
            [("q", i + 1, c) for i, c in enumerate("abc")] * 2 + [("p", i + 1, c) for i, c in enumerate("fed")]
        )
    retrieval.QUERY_BATCH = 512


def test_store_pointer_is_never_half_written(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("1", "t", 0)], "chunk_id string, chunk_type string, chunk_idx int")
    assert not store.exists()
    for n in (1, 2, 3):
        store.write(rows)
        assert store._manifests()[-1] == f"CURRENT-{n:012d}" and store.count() == 1
    (tmp_path / "s" / "CURRENT-000000000004").write_text("")
    assert store.count() == 1 and store.read().count() == 1
    store.vacuum(2)
    assert len(store._manifests()) == 2 and store.read().count() == 1


def test_empty_statistics_have_a_total(spark):
    empty = spark.createDataFrame([], "category string, vendor string, chunk_type string, model string")
    assert [tuple(r) for r in stats.collection_stats(empty).collect()] == [("total", "", 0)]
