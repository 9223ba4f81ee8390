"""What the rounds of near-duplicate removal move."""
from docmill.operators import dedup
from docmill.session import cut_lineage, session_setting


def test_a_round_moves_texts_once(spark):
    texts = spark.createDataFrame([("d", b, ["x"]) for b in range(6)], "doc_name string, _blk bigint, texts array<string>")
    now = spark.createDataFrame([("d", b, "a", "e", ["t"], [True]) for b in range(6)], "doc_name string, _blk bigint, assumed string, ended string, tail array<string>, flags array<boolean>")
    stale = spark.createDataFrame([("d", 3, ["s"])], "doc_name string, _blk bigint, start array<string>")
    with session_setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        work = dedup._work(cut_lineage(texts), cut_lineage(now), cut_lineage(stale), 1)
        assert sorted((r._super, r._blk, r.start) for r in work.collect()) == [(1, 3, ["s"])]
        plan = work._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan =="):plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    moved = [line for line in final.splitlines() if " Exchange hashpartitioning" in line and "texts" in line]
    by_super = [line for line in final.splitlines() if " Exchange hashpartitioning(doc_name" in line and "_super" in line]
    assert "SortMergeJoin" in final and len(by_super) <= 3 and len(moved) <= 1
