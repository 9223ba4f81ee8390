"""Sources, store, metadata and the whole ingest."""
import json

import pytest

from docmill.operators import meta
from docmill.operators.chunk import chunk_pages
from docmill.plans import pipeline, retrieval, stats
from docmill.sources import documents as src
from docmill.sources.embedders import hashing_embedding
from docmill.sources.store import VectorStore

BOX = ("x0", "y0", "x1", "y1")


def block(text, *box):
    return {**dict(zip(BOX, map(float, box))), "text": text}


def decode(content):
    """Test files are JSON lists of page elements."""
    return json.loads(content)


def sheet(code, flow):
    return [{
        "page": 1,
        "blocks": [block(f"Guide by Acme Systems | {code} Pump Gateway | Data Sheet", 0, 0, 99, 9), block("cell text", 10, 50, 20, 60)],
        "plain": None,
        "tables": [{**dict(zip(BOX, (0.0, 40.0, 99.0, 90.0))), "headers": ["Spec", code], "rows": [["Inlet\n flow", flow], [None, "x"]]}],
        "ocr": [], "logo": [{"text": "ACME", "conf": 0.9}, {"text": "??", "conf": 0.1}],
    }, {
        "page": 2, "plain": "word " * 60 + "\n© 2024 Acme Systems, Inc.", "blocks": [], "tables": [], "ocr": [], "logo": [],
    }, {
        "page": 3, "plain": "tiny", "blocks": [], "tables": [], "logo": [],
        "ocr": [{"text": "scanned", "conf": 0.8}, {"text": " ", "conf": 0.9}, {"text": "page", "conf": 0.61}, {"text": "no", "conf": 0.6}],
    }, {"page": 4, "plain": " \n", "blocks": [], "tables": [], "ocr": [], "logo": []}]


@pytest.fixture()
def folder(tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_text(json.dumps(sheet("QX-2100A", "5 lps")))
    (files / "b.pdf").write_text(json.dumps(sheet("QX-2300A", "7 lps")))
    (files / "broken.pdf").write_text("not json")
    (files / "empty.pdf").write_text("[]")
    (files / "dots.pdf").write_text(json.dumps([{"page": 1, "plain": "--\n12", "blocks": [], "tables": [], "ocr": [], "logo": []}]))
    (files / "note.txt").write_text("[]")
    (files / "deeper").mkdir()
    (files / "deeper" / "c.pdf").write_text("[]")
    return str(files)


def test_pages_from_elements(spark, folder):
    pages = src.assemble_pages(src.decode_files(src.scan_directory(spark, folder), decode))
    rows = {(r["doc_name"], r["page"]): r for r in pages.collect()}
    assert set(rows) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("b.pdf", 1), ("b.pdf", 2), ("b.pdf", 3), ("dots.pdf", 1)}
    first = rows["a.pdf", 1]
    assert first["text"] == (
        "Guide by Acme Systems | QX-2100A Pump Gateway | Data Sheet\n\n<!-- TABLE -->\n"
        "Spec | QX-2100A\n--- | ---\nInlet flow | 5 lps\n | x"
    )
    assert first["has_tables"] and not first["ocr_used"] and first["logo_text"] == "ACME"
    assert rows["a.pdf", 3]["ocr_used"] and rows["a.pdf", 3]["text"] == "scanned page"


def test_missing_reader_is_reported(spark, folder):
    rows = src.decode_files(src.scan_directory(spark, folder)).collect()
    assert len(rows) == 5 and all(r["error"] for r in rows)


def test_ingest_directory(spark, folder, tmp_path):
    store_path = str(tmp_path / "store")
    report = pipeline.ingest_directory(spark, folder, store_path, decoder=decode, embed=hashing_embedding)
    rows = {r["file"]: r for r in report.collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "broken.pdf", "empty.pdf", "dots.pdf"}
    a = rows["a.pdf"]
    assert (a["status"], a["vendor"], a["models"], a["pages"], a["ocr_pages"]) == ("success", "Acme Systems", ["QX-2100A"], 3, 1)
    assert rows["broken.pdf"]["status"] == "failed" and rows["broken.pdf"]["error"]
    assert rows["empty.pdf"]["error"] == "No text extracted."
    assert rows["dots.pdf"]["error"] == "All pages empty."

    store = VectorStore(spark, store_path)
    chunks = store.read()
    specs = {(r["model"], r["spec_name"], r["spec_value"]) for r in store.read({"chunk_type": "spec_row"}).collect()}
    assert specs == {("QX-2100A", "Inlet flow", "5 lps"), ("QX-2300A", "Inlet flow", "7 lps")}
    by_doc = {}
    for r in chunks.collect():
        by_doc.setdefault(r["doc_name"], []).append(r["chunk_idx"])
    assert all(sorted(ix) == list(range(len(ix))) for ix in by_doc.values())
    assert a["chunks"] == len(by_doc["a.pdf"])

    # the same files again change nothing
    total = store.count()
    pipeline.ingest_directory(spark, folder, store_path, decoder=decode, embed=hashing_embedding)
    assert store.count() == total == chunks_ids(store)

    known = store.read({"chunk_type": "spec_row", "model": "QX-2300A"}).first()["text"]
    hits = retrieval.retrieve(store, [known], hashing_embedding, 2).collect()
    assert hits[0]["chunk_type"] == "spec_row" and "QX-2300A" in hits[0]["preview"] and [h["rank"] for h in hits] == [1, 2]
    session = retrieval.session_report(store, ["flow"], hashing_embedding)
    assert session["counts"].count() == 3 and session["samples"].count() == 2
    assert stats.stats_report(store.read()).where("dimension = 'total'").first()["n"] == total
    store.reset()
    assert store.count() == 0 and not store.exists()


def chunks_ids(store):
    return store.read().select("chunk_id").distinct().count()


def test_upsert_replaces_and_keeps_orphans(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame(items, "chunk_id string, chunk_idx long, doc_name string, chunk_type string, text string")

    store = VectorStore(spark, str(tmp_path / "s"))
    store.upsert(rows(("1", 0, "d", "semantic", "old"), ("2", 1, "d", "semantic", "b"), ("2", 2, "d", "semantic", "late copy")))
    store.upsert(rows(("1", 0, "d", "semantic", "new"), ("3", 0, "e", "table_full", "c")))
    assert {(r["chunk_id"], r["text"]) for r in store.read().collect()} == {("1", "new"), ("2", "b"), ("3", "c")}
    store.upsert(rows(("4", 0, "d", "semantic", "only")), replace_documents=True)
    assert {r["chunk_id"] for r in store.read(columns=["chunk_id"]).collect()} == {"3", "4"}
    plan = store.read({"chunk_type": "semantic"}, ["chunk_id"])._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(chunk_type), EqualTo(chunk_type,semantic)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def held(store):
    return {tuple(r) for r in store.read(columns=["chunk_id", "text"]).collect()}


def test_an_upsert_writes_only_its_rows(spark, tmp_path):
    """Old files stay as they are; new ones lie in the buckets of the new ids."""
    store = VectorStore(spark, str(tmp_path / "s"), buckets=8)
    rows = lambda ids, text: spark.createDataFrame([(str(i), i, "d", "semantic", text) for i in ids], "chunk_id string, chunk_idx long, doc_name string, chunk_type string, text string")
    store.upsert(rows(range(200), "old"))
    before, want = files(tmp_path / "s"), {(str(i), "old") for i in range(200)}
    for turn, ids in enumerate(([3, 5], [5, 400], [3], list(range(0, 200, 7)))):
        store.upsert(rows(ids, f"new {turn}"))
        after = files(tmp_path / "s")
        assert before.items() <= after.items()
        made = [f for f in after.keys() - before.keys() if f.startswith("data/")]
        bucket = spark.createDataFrame([(str(i),) for i in ids], "c string").selectExpr("pmod(xxhash64(c), 8)").distinct().collect()
        assert {int(f.split("_bucket=")[1].split("/")[0]) for f in made} == {r[0] for r in bucket}
        want = {(i, t) for i, t in want if int(i) not in ids} | {(str(i), f"new {turn}") for i in ids}
        assert held(store) == want and store.count() == len(want)
        before = after
    store.compact(2)
    assert held(store) == want and store.count() == len(want) and all(sum(b in s["buckets"] for s in store.current()["segments"]) < 3 for b in range(8))
    store.upsert(rows([3, 9], "last"))
    want = {(i, t) for i, t in want if i not in ("3", "9")} | {("3", "last"), ("9", "last")}
    assert held(store) == want and store.count() == len(want)
    store.compact(1)
    store.vacuum(1)
    assert held(store) == want and {r["value"]: r["n"] for r in store.stats().where("dimension = 'total'").collect()} == {"": len(want)}
    assert len({f.split("/")[1] for f in files(tmp_path / "s") if f.startswith("data/")}) == len(store.current()["segments"])


def test_ranges_skip_segments(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    rows = lambda ids, vendor: spark.createDataFrame([(str(i), i, vendor, "é" * 80 + (vendor or "")) for i in ids], "chunk_id string, chunk_idx long, vendor string, model string")
    store.upsert(rows(range(5), "Acme"))
    store.upsert(rows(range(5, 9), "Bolt"))
    store.upsert(rows(range(9, 12), None))
    opened = lambda **where: len(store.segments_for(where))
    assert opened() == 3 and opened(vendor="Acme") == opened(vendor="Bolt") == 1 and opened(vendor="Ball") == 0
    assert opened(chunk_idx=10) == 1 and opened(chunk_idx=12) == 0 and opened(model="é" * 80 + "Acme") == 3
    assert store.read({"model": "é" * 80 + "Acme"}).count() == 5 and store.read({"vendor": "Ball"}).count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second finds the name taken and starts over on top of the first."""
    path = str(tmp_path / "s")
    rows = lambda i, text: spark.createDataFrame([(str(i), i, text)], "chunk_id string, chunk_idx long, text string")
    first, second = VectorStore(spark, path), VectorStore(spark, path)
    first.upsert(rows(1, "a"))
    stale = second.current()
    first.upsert(rows(1, "b"))
    seen = iter([stale])
    read = second.current
    monkeypatch.setattr(second, "current", lambda: next(seen, None) or read())
    second.upsert(rows(2, "c"))
    assert held(first) == {("1", "b"), ("2", "c")}
    # a manifest that was cut short doesn't count
    (tmp_path / "s" / "CURRENT-000000000099").write_text('{"number": 99')
    assert held(VectorStore(spark, path)) == {("1", "b"), ("2", "c")}


def test_metadata_across_pages(spark):
    pages = [
        ("acme_ax.pdf", 1, "AX Gear by Acme Systems | AX Widget Gateway | Data Sheet\nAcme's patented stuff ICSA®\nAX-1200 Series AX-1210 AX-1220-DC BIG-IP"),
        ("acme_ax.pdf", 2, "i5800 and i5900 FIM-7921F SHA-256 AX-1230-DS-R1 AX-1230 SR-1500\n© 2024"),
        ("acme_ax.pdf", 7, "Bolt Works, Inc. more text ax-1210"),
        ("pa-410-series.pdf", 1, "nothing here"),
    ]
    out = {r["doc_name"]: r for r in meta.extract_doc_meta(
        spark.createDataFrame(pages, "doc_name string, page long, text string")).collect()}
    acme = out["acme_ax.pdf"]
    assert acme["vendor"] == "Bolt Works" and acme["source"] == "content"
    assert acme["models"] == ["AX-1210", "AX-1220-DC", "BIG-IP i5800", "ax-1210", "i5900"]
    assert acme["components"] == ["FIM-7921F"] and acme["family_identifiers"] == ["AX-1200"]
    other = out["pa-410-series.pdf"]
    assert (other["vendor"], other["family"], other["source"]) == ("Palo Alto", "PA-410 Series", "filename_fallback")


def test_vendor_ties_go_by_name(spark):
    rows = [("d", n, 16, 2) for n in ("Beta", "Acme", "Zeta")] + [("d", "Longer", 12, 9)]
    df = spark.createDataFrame(rows, "doc_name string, name string, weight int, freq long")
    assert meta.best_vendor(df).first()["vendor"] == "Acme"


def test_chunks_without_models_have_no_specs(spark):
    page = "x" * 90 + "\n\n[TABLE]\nSpec | QX-2100A\n--- | ---\nFlow | 5\n[/TABLE]"
    pages = spark.createDataFrame([("d", 1, page)], "doc_name string, page long, text string")
    info = "doc_name string, vendor string, product_family string, category string, models array<string>"
    for models, kinds in (([], ["semantic", "table_full"]), (["QX-2100A"], ["semantic", "table_full", "spec_row"])):
        doc = spark.createDataFrame([("d", "Acme", "Fam", "NGFW", models)], info)
        rows = chunk_pages(pages, doc).orderBy("chunk_idx").collect()
        assert [r["chunk_type"] for r in rows] == kinds
        assert all(r["family"] == r["display_family"] == "Fam" for r in rows)
    spec = rows[-1]
    assert spec["text"] == (
        "Vendor: Acme\nFamily: Fam\nModel: QX-2100A\n\nFeature: Flow\nValue: 5\n\n"
        "Context: Acme Fam NGFW technical specification"
    )
    assert (spec["metric"], spec["value"], rows[0]["metric"], rows[0]["model"]) == ("Flow", "5", None, "")


def test_top_k_breaks_ties_by_id(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [3.0, 0.0])], "query_id string, embedding array<double>")
    got = retrieval.top_k(vectors, queries, 3).orderBy("rank").collect()
    assert [(r["id"], round(r["similarity"], 6)) for r in got] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_few_chars_are_counted_on_every_boundary(spark):
    """Category terms across page borders, also over very short pages."""
    from docmill.operators.classify import body_terms, page_evidence

    pages = [("d", 1, "a load"), ("d", 2, "Balancer x web"), ("d", 3, "application"), ("d", 4, "..."), ("d", 5, "firewall")]
    df = spark.createDataFrame(pages, "doc_name string, page long, text string")
    terms = ["load balancer", "web application firewall", "waf", "x w"]
    assert sorted(body_terms(page_evidence(df, terms), terms).first()["body_hits"]) == ["load balancer", "web application firewall", "x w"]


def test_nothing_readable(spark, folder, tmp_path):
    """Every file fails: the report says so, the store stays empty but usable."""
    store_path = str(tmp_path / "none")
    report = pipeline.ingest_directory(spark, folder, store_path, embed=hashing_embedding)
    assert {r["status"] for r in report.collect()} == {"failed"} and report.count() == 5
    store = VectorStore(spark, store_path)
    assert store.count() == 0
    pipeline.ingest_directory(spark, folder, store_path, decoder=decode, embed=hashing_embedding)
    assert store.count() > 0
