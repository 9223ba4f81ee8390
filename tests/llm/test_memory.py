"""What stages of the pipeline hold at once."""
import pyarrow as pa
from pyspark.sql import functions as F

from docmill.llm import decontaminate, lines, pieces, queries, worker


def test_decontamination_is_one_python_step(spark):
    """Each Python step of a task has a worker of its own."""
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"Own words {i}. {passage} " + "more of it " * 20) for i in range(1100)] + [(9999, None)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", passage), ("b", "another item of the benchmark")], "item_id string, text string")
    clean = decontaminate.without_spans(docs, items)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert len(texts) == 1101 and texts[9999] is None and all("p3" not in t and "more" in t for i, t in texts.items() if i != 9999)
    blocks = decontaminate.without_spans(docs, items, block_words=12)
    assert {r.doc_id: r.text for r in blocks.collect()} == texts


def test_lines_are_counted_once_a_page(spark):
    rows = [("h", f"Home | About\nHome | About\nown {i % 7}") for i in range(70)] + [("g", "Home | About\nx"), (None, "x"), ("h", None)]
    docs = spark.createDataFrame(rows, "source string, text string")
    pages = lines.pages_of(docs, F.col("source"), F.col("text"))
    # rows that move are pages, not lines
    assert sorted((r.host, len(r.lines)) for r in pages.collect()) == [("", 1), ("g", 2), *[("h", 2)] * 7]
    found = lines.boilerplate(pages.cache(), ratio=0.5)
    assert [(r.host, r.pages, r.total) for r in found.collect()] == [("h", 7, 7)]


def test_stages_pass_few_texts_to_a_worker_at_once(spark):
    import corpus_pipeline

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = [r.n for r in corpus_pipeline.in_small_batches(sizes)(spark, spark.range(0, 5000, 1, 1), "").collect()]
    assert sum(n) == 5000 and max(n) <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    stages = dict(corpus_pipeline.STAGES)
    assert all(hasattr(stages[name], "__wrapped__") for name in ("quality", "decontamination", "pieces"))


def test_strings_seen_once_are_not_remembered():
    model = queries.piece_model()
    groups = [[f"again and again w{g}x{i} q{g}y{i}, z{i}\n" for i in range(300)] for g in range(4)]
    coded = [model.encode_many(texts) for texts in groups]
    known = worker.kept(model._name, pieces.Memory).known
    # those of one group only are gone, those of several are there
    assert " and" in known and " z7" in known and not any(p.startswith((" w", " q")) for p in known)
    assert len(known) < 1000
    for texts, found in zip(groups, coded):
        for k in (0, 150, 299):
            text = " " + texts[k] if model.dummy_prefix else texts[k]
            assert found[k] == pieces.np.array(model.search(text), "int32").tobytes()
