"""Extra columns that clash with names used inside, and rows that count once."""
import pytest
from pyspark.sql import functions as F

from docmill.llm import decontaminate, lines, minhash, pieces, pii, quality, queries, secret_spans, sharding, spans
from tests.llm.test_operators import FOLDER

INNER = "host of bad kept salt s t doc ats gone all its_slot its_shard match label score key id a b _of _bad _gone _t _match _score _slot rows tags pooled component".split()
TEXT = "Home | About\nThe first sentence of some length. The second one, longer still! {i}\npassword=abcdef{i} mail a{i}@b.c"


def table(spark):
    rows = [(i, None if i == 8 else TEXT.format(i=i), "en", "h", 9, *["x"] * len(INNER)) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in INNER))


def operators():
    import corpus_pipeline

    items = lambda spark: spark.createDataFrame([("a", "nothing of this")], "item_id string, text string")
    yield "lines", lambda s, d: lines.without_boilerplate(d, F.col("source"), dropped="n")
    yield "lines of groups", lambda s, d: lines.without_boilerplate(d, F.col("source"), near_copies=True)
    yield "spans", lambda s, d: spans.without_repeats(d)
    yield "sharding", lambda s, d: sharding.place(d, F.col("doc_id"), sharding.lookup_table(sharding.named_shards(s, 3), 11), 11)
    yield "matches", lambda s, d: decontaminate.matches(d, items(s))
    yield "decontamination", lambda s, d: decontaminate.without_spans(d, items(s))
    yield "personal data", lambda s, d: pii.personal_data(d)
    yield "secrets", lambda s, d: secret_spans.secrets(d, secret_spans.train(d))
    yield "pieces", lambda s, d: pieces.decode(pieces.encode(d, queries.piece_model()), queries.piece_model())
    yield "quality", lambda s, d: quality.score(d, quality.train(d, s.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, 5, "x")], "doc_id long, quality int, label string")), name="p")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        yield f"stage {name}", lambda s, d, f=stage: f(s, d, FOLDER)


@pytest.mark.parametrize("name", [n for n, _ in operators()])
def test_clashing_columns(spark, name):
    run = dict(operators())[name]
    docs = table(spark)
    got = run(spark, docs)
    assert all(r[c] == "x" for r in got.collect() for c in INNER)
    assert name.startswith("stage") or got.count() == 10 and got.where("text IS NULL").count() == 1
    assert run(spark, docs.limit(0)).count() == 0
    left = minhash.one_of_each(docs).collect() if name == "stage near_duplicates" else []
    assert all(r[c] == "x" for r in left for c in INNER)


def test_near_copies_count_once_in_the_total(spark):
    body = [" ".join(f"w{i}x{k}" for i in range(12)) for k in range(30)]
    rows = [(i, "\n".join(["Home | About", *body, f"own {i}"]), "h") for i in range(40)]
    rows += [(100 + i, "\n".join(["Home | About", *[f"other {i} {k} " + " ".join(f"z{i}{k}{j}" for j in range(9)) for k in range(5)]]), "h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in lines.without_boilerplate(docs, F.col("source"), ratio=0.5, near_copies=True).collect()}
    assert all("Home" not in t for t in clean.values()) and all(body[0] in clean[i] for i in range(40))


def test_unknown_bytes_have_the_unknown_id():
    small = pieces.Pieces([("<unk>", 0.0, "unknown"), ("a", -1.0, "normal")], False)
    assert small.search("aéa") == [1, 0, 0, 1]
