"""More questions than travel with a scan."""
import numpy as np

from docmill.checks.store import topk_of_all
from docmill.plans import retrieval


def test_vectors_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BATCH", 2)
    monkeypatch.setattr(retrieval, "GROUP", 2)
    monkeypatch.setattr(retrieval, "VECTOR_BATCH", 3)
    met, plans = retrieval._met, []

    def watched(chunks, asked):
        plans.append(met(chunks, asked))
        return plans[-1]

    monkeypatch.setattr(retrieval, "_met", watched)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(40, 4))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(data)], "chunk_id string, embedding array<double>")
    got = retrieval.top_k(rows, rows.where("chunk_id < '3'").withColumnRenamed("chunk_id", "query_id"), 3).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    asked = [i for i in range(40) if str(i) < "3"]
    want = {(str(i), r + 1, str(j)) for i in asked for r, j in enumerate(np.argsort(-unit @ unit[i])[:3])}
    assert {(g.query_id, g.rank, g.id) for g in got} == want
    assert len(plans) == -(-len(asked) // 4)
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" in text and "hashpartitioning" not in text


def test_questions_are_the_ids_divisible_by_50(spark):
    asked = {int(r.query_id) for r in topk_of_all(spark, "/root/testdata/sf0.001").collect()}
    assert asked and all(q % 50 == 0 for q in asked)
