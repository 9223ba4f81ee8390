"""Table shapes, one literal table each."""
import pytest
from pyspark.sql import functions as F

from docmill.operators import tables as tb

KNOWN = ["QX-2100A", "QX-2100A-DC", "QX-2300A"]
RULE = "--- | --- | ---"


def table(*lines):
    return "\n".join(["[TABLE]", *lines, "[/TABLE]"])


CASES = {
    "columns": (
        table("Spec | QX-2100A | QX-2100A-DC | QX-2300A", RULE, "Inlet Flow | 5 lps | 5 lps | 7 lps", "Outlet Flow | 3 lps | 3 lps | 4 lps"),
        KNOWN, "", "column", 6, ("QX-2300A", "Outlet Flow", "4 lps"),
    ),
    "generic header": (
        table("DESCRIPTION | SKU | URL", RULE, "Yearly plan | QX-2100A-PLAN | https://example.invalid"), KNOWN, "", "none", 0, None,
    ),
    "placeholder header": (
        table("Col0 | Col1 | Col2", RULE, "Spec | PA-311 | PA-315", "Inlet flow | 2.4 lps | 3.8 lps", "Tunnel flow | 1.2 lps | 2 lps"),
        ["PA-311", "PA-315"], "", "column", 4, ("PA-315", "Inlet flow", "3.8 lps"),
    ),
    "title line": (
        table("QX 2000 Line", "--- | --- | --- | ---", "Spec | QX-2100A | QX-2100A-DC | QX-2300A", "Inlet Flow | 5 lps | 5 lps | 7 lps"),
        KNOWN, "", "column", 3, ("QX-2300A", "Inlet Flow", "7 lps"),
    ),
    "rows": (
        table("Model | Inlet Flow | Outlet Flow", RULE, "QX-2100A | 5 lps | 3 lps", "QX-2300A | 7 lps | 4 lps"),
        KNOWN, "", "row", 4, ("QX-2300A", "Outlet Flow", "4 lps"),
    ),
    "headerless": (
        table("PA-311 | 7.5 lps | Inlet flow (mixed)*", RULE, "PA-315 | 9.0 lps | Inlet flow (mixed)*"),
        ["PA-311", "PA-315"], "", "headerless", 2, ("PA-311", "Inlet flow (mixed)*", "7.5 lps"),
    ),
    "grouped in prose": (
        table("Ports |  | ", RULE, "Outlet Flow (Mixed) | 405 lps | 405 lps", "Inlet Flow | 324 lps | 324 lps"),
        ["QX-2100A", "QX-2100A-DC", "QX-2100A-2", "QX-2100A-2-DC"],
        "QX-2100A/\nQX-2100A-DC\nQX-2100A-2/\nQX-2100A-2-DC\n\n", "contextual", 8, ("QX-2100A-2-DC", "Inlet Flow", "324 lps"),
    ),
    "two groups, three columns": (
        table("Ports |  |  | ", "--- | --- | --- | ---", "Inlet Flow | 1 lps | 2 lps | 3 lps"),
        ["QX-2100A", "QX-2100A-DC", "QX-2300A", "QX-2300A-DC"], "QX-2100A/QX-2100A-DC and QX-2300A/QX-2300A-DC\n", "none", 0, None,
    ),
    "placeholder cells": (table("Col0 | Col1", "--- | ---", "Col0 | Col0"), KNOWN, "QX-2100A/\nQX-2100A-DC\n", "none", 0, None),
    # the header's label holds a digit, is its own nearest value, and stops the rest
    "digits in a header label": (
        table("Flow 64 unit size | QX-2100A", "--- | ---", "Inlet flow | 5 lps"), KNOWN, "", "headerless", 1,
        ("QX-2100A", "Flow 64 unit size", "Flow 64 unit size"),
    ),
    # the value is label-like and longer than the metric
    "value longer than metric": (
        table("QX-2100A | 405 Gbps | IPS", RULE), KNOWN, "", "none", 0, None,
    ),
    "empty first cell moves left": (
        table("Spec | QX-2100A | QX-2300A", RULE, "| 5 | 6"), KNOWN, "", "column", 1, ("QX-2100A", "5", "6"),
    ),
    "thousands": (table("Spec | QX-2100A", "--- | ---", "Sessions | 1,000"), KNOWN, "", "column", 1, ("QX-2100A", "Sessions", "1")),
    "other spelling": (
        table("Spec | qx-2300a", "--- | ---", "Inlet Flow | 5 lps"), KNOWN, "", "column", 2, ("qx-2300a", "Inlet Flow", "5 lps"),
    ),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, 1, text, known, before + text) for name, (text, known, before, *_) in CASES.items()]
    df = spark.createDataFrame(rows, "doc_name string, page int, text string, known array<string>, page_text string")
    return {r["doc_name"]: (r["strategy"], [tuple(s) for s in r["specs"]]) for r in tb.table_specs(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_shape(results, name):
    *_, strategy, count, example = CASES[name]
    got_strategy, specs = results[name]
    assert (got_strategy, len(specs)) == (strategy, count), specs
    assert example is None or example in specs


def test_options(spark):
    text = table("Spec | QX-2100A | QX-2300A", RULE, "Sessions | 1,000 | 10,500", "| 5 | 6")
    df = spark.createDataFrame([("d", 1, text, KNOWN, text)], "doc_name string, page int, text string, known array<string>, page_text string")
    specs = [tuple(s) for s in tb.table_specs(df, preserve_thousands=True, keep_edge_cells=True).first()["specs"]]
    assert specs == [("QX-2100A", "Sessions", "1,000"), ("QX-2300A", "Sessions", "10,500")]


def test_page_models_are_found_by_token(spark):
    pages = spark.createDataFrame([("d", 1, 0, "t", "see BIG-IP i5800, (qx-2100a) and ßQX-2300A. XQX-9 QX-2100A-DC5")],
                                  "doc_name string, page long, seg int, text string, page_text string")
    models = spark.createDataFrame([("d", m) for m in ["BIG-IP i5800", "QX-2100A", "QX-2300A", "QX-9", "QX-2100A-DC", "i5800"]], "doc_name string, model string")
    known = tb.attach_page_models(pages, models).first()["known"]
    assert known == ["BIG-IP i5800", "QX-2100A", "QX-2300A", "i5800"]


def test_known_models(spark):
    row = spark.range(1).select(tb.known_models(
        F.array(*map(F.lit, ["AB-100", "FIM-1234F", "AB-100-DC", "XY-200", "AB-100", "ZZ-300"])),
        F.array(F.lit("zz-300")), F.array(F.lit("xy-200")),
    ).alias("m")).first()
    assert row["m"] == ["AB-100-DC", "AB-100"]
