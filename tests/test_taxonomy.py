"""The taxonomy parameter and its two matchers."""
import re
import sys

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docmill.functions.text import normalise_terms
from docmill.operators.classify import detect_category
from docmill.taxonomy import all_terms, has_term, load_taxonomy, longest_term_pattern, normalise_term, term_finder, term_hits

TERMS = ["ab", "abc", "abc d", "b", "cab", "d-a", "bca"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd -", max_size=30))
def test_pattern_implies_every_term(text):
    longest = set(re.findall(longest_term_pattern(TERMS), text))
    for term in TERMS:
        assert any(h.startswith(term) for h in longest) == (term in text)


def test_matchers_agree(spark, monkeypatch):
    terms = all_terms(load_taxonomy())
    texts = ["a load balancer with waf and ips throughput", "nothing", "sd-wan router bgp siem soc", "hyper-converged infra"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def found():
        flags = F.transform(F.array(*map(F.lit, terms)), lambda k: has_term(F.col("h"), k))
        return [tuple(r[0]) for r in df.select(term_hits(F.col("t"), terms).alias("h")).select(flags).collect()]

    expected = [tuple(k in t for k in terms) for t in texts]
    assert found() == expected
    # the choice is made where the texts are read
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    find = term_finder(terms)
    assert [tuple(any(h.startswith(k) for h in find(t)) for k in terms) for t in texts] == expected


def test_taxonomy_shape():
    taxonomy = load_taxonomy()
    assert [c.ord for c in taxonomy] == list(range(1, 27))
    assert (sum(len(c.keywords) for c in taxonomy), sum(len(c.titles) for c in taxonomy), sum(len(c.negatives) for c in taxonomy)) == (242, 68, 21)
    assert normalise_term("802.1q, Wi-Fi") == "802 1q wi-fi"


def test_own_taxonomy_and_ties(spark, tmp_path):
    path = tmp_path / "own.md"
    path.write_text("| 1 | `PUMPS` | pump, valve, water pump | pump | fan | x |\n| 2 | `FANS` | fan, valve | fan | — | x |\n")
    taxonomy = load_taxonomy(path)
    pages = spark.createDataFrame(
        [("big_pump.pdf", 1, "The water\n"), ("big_pump.pdf", 2, "PUMP, fan"), ("x.pdf", 1, "valve"), ("y.pdf", 1, "none")],
        "doc_name string, page long, text string",
    )
    got = {r["doc_name"]: (r["category"], r["score"], r["second"], r["confidence"]) for r in detect_category(pages, taxonomy=taxonomy).collect()}
    # file name 3 + 5; head 2 + 2; body 1 + 1; the fan costs 2 in the head
    assert got["big_pump.pdf"] == ("PUMPS", 12.0, 3.0, 0.6)
    assert got["x.pdf"] == ("PUMPS", 3.0, 3.0, 0.0) and got["y.pdf"] == ("GENERAL", 0.0, 0.0, 0.0)


def test_normalise_terms_equals_the_definition(spark):
    texts = ["  A.B_c-d\n\tÉ!!", "", "--", "x  y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(normalise_terms(F.col("t"))).collect()] == [normalise_term(t) for t in texts]
