"""Relations of a corpus that share costly steps."""
from docmill.operators.meta import doc_meta_relations


def test_pages_are_ordered_once_for_all_relations(spark):
    rows = [(f"d{i % 2}.pdf", i, f"© 20{10 + i} Acme Inc.\nModel AB-{100 + i} and AB-7 on page {i}") for i in range(6)]
    parts = doc_meta_relations(spark.createDataFrame(rows, "doc_name string, page long, text string"))
    plans = {name: part._jdf.queryExecution().optimizedPlan().toString() for name, part in parts.items()}
    assert [name for name, plan in plans.items() if "Window" in plan] == []
    models = {(r.doc_name, r.model) for r in parts["models"].collect()}
    assert {(f"d{i % 2}.pdf", f"AB-{100 + i}") for i in range(6)} <= models
