"""Classification queries."""
from pyspark.sql import functions as F

from docmill.checks.common import PAGES_SQL, WORD_RE, WS_RE, documents, pages, sql_text, strip_sql
from docmill.operators import classify
from docmill.operators.ordering import doc_heads, first_pages
from docmill.sources.documents import pages_table
from docmill.taxonomy import load_taxonomy


def category_scores(spark, folder):
    """Each document by itself; the file name is the document's source and id."""
    docs = documents(spark, folder)
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    one = pages_table(docs, name, F.lit(1), F.col("text"))
    return classify.category_scores(one)


def category_best(spark, folder):
    return classify.detect_category(pages(spark, folder)).select("doc_name", "category", "score", "second")


def category_confidence(spark, folder):
    docs = documents(spark, folder)
    name = F.concat("lang", F.lit("-switch-router_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    one = pages_table(docs, name, F.lit(1), F.col("text"))
    return classify.detect_category(one).select("doc_name", "category", "confidence", "low_confidence")


def document_heads(spark, folder):
    return doc_heads(pages(spark, folder), "text", 1000)


def leading_pages(spark, folder):
    return first_pages(pages(spark, folder), 3)


def norm_sql(x):
    words = f"regexp_replace(lower({x}), '[^{WORD_RE}{WS_RE}-]', ' ', 'g')"
    return strip_sql(f"regexp_replace({words}, '[{WS_RE}]+', ' ', 'g')")


def terms_sql():
    rows = [
        f"({c.ord}, {sql_text(c.name)}, {sql_text(kind)}, {sql_text(term)})"
        for c in load_taxonomy()
        for kind, terms in (("k", c.keywords), ("t", c.titles), ("n", c.negatives))
        for term in terms
    ]
    return f"terms(ord, category, kind, term) AS (VALUES {', '.join(rows)})"


def scores_sql(files: str) -> str:
    """CTE ``scores`` from a query of (doc_name, text), one row per file."""
    return f"""files AS ({files}), {terms_sql()},
  norm AS MATERIALIZED (SELECT doc_name, {norm_sql('doc_name')} AS f, {norm_sql('left(text, 1000)')} AS h, {norm_sql('text')} AS b FROM files),
  scores AS (SELECT doc_name, ord, category, greatest(sum(CASE kind
      WHEN 'k' THEN 3 * contains(f, term)::INT + 2 * contains(h, term)::INT + contains(b, term)::INT
      WHEN 't' THEN 5 * contains(f, term)::INT
      ELSE -4 * contains(f, term)::INT - 2 * contains(h, term)::INT END), 0)::DOUBLE AS score
    FROM norm, terms GROUP BY ALL)"""


RANKED_SQL = """ranked AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second,
    FROM scores WINDOW w AS (PARTITION BY doc_name ORDER BY score DESC, ord))"""

_JOINED = f"WITH {PAGES_SQL} SELECT doc_name, string_agg(text, chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_name"

QUERIES = {
    "category_scores": (
        category_scores,
        "WITH " + scores_sql(
            f"SELECT source || '_' || doc_id || '.pdf' AS doc_name, text FROM documents WHERE {strip_sql('text')} <> ''"
        ) + " SELECT doc_name, category, score FROM scores",
    ),
    "category_best": (
        category_best,
        f"WITH {scores_sql(_JOINED)}, {RANKED_SQL}"
        " SELECT doc_name, CASE WHEN score > 0 THEN category ELSE 'GENERAL' END AS category, score, second"
        " FROM ranked WHERE r = 1",
    ),
    "category_confidence": (
        category_confidence,
        "WITH " + scores_sql(
            f"SELECT lang || '-switch-router_' || doc_id || '.pdf' AS doc_name, text FROM documents WHERE {strip_sql('text')} <> ''"
        ) + f""", {RANKED_SQL},
        c AS (SELECT *, CASE WHEN score > 0 THEN (score - second) / (score + second) ELSE 0 END AS conf FROM ranked WHERE r = 1)
        SELECT doc_name, CASE WHEN score > 0 THEN category ELSE 'GENERAL' END AS category,
          round_even(conf, 3)::DOUBLE AS confidence, score > 0 AND conf < 0.35 AS low_confidence FROM c""",
    ),
    "document_heads": (
        document_heads,
        f"WITH {PAGES_SQL} SELECT doc_name, left(string_agg(text, chr(10) ORDER BY page), 1000) AS head FROM pages GROUP BY doc_name",
    ),
    "leading_pages": (
        leading_pages,
        f"WITH {PAGES_SQL} SELECT doc_name, page FROM pages"
        " QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY page) <= 3",
    ),
}
