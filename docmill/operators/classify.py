"""Category detection.

Terms are looked up by scanning each text once, not by joining documents with
terms. Body evidence is collected per page and united per document, together
with the hits that lie across page borders, so no document is ever assembled.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill import fixed
from docmill.functions.stage import computed
from docmill.functions.text import let, normalise_terms
from docmill.operators.ordering import DOC, doc_heads, seams_of
from docmill.session import cut_lineage, session_setting
from docmill.taxonomy import Category, all_terms, has_term, load_taxonomy, term_hits

#: Whole pages that pass to a worker at once; one may be long.
PAGES_PER_BATCH = "256"


def _terms_literal(terms) -> Column:
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def category_scores_column(name_hits, head_hits, body_hits, taxonomy: list[Category]) -> Column:
    """Array of (score, ord, category) for every category, from the hit arrays."""
    cats = F.array(*[
        F.struct(
            F.lit(c.ord).alias("ord"),
            F.lit(c.name).alias("category"),
            _terms_literal(c.keywords).alias("keywords"),
            _terms_literal(c.titles).alias("titles"),
            _terms_literal(c.negatives).alias("negatives"),
        )
        for c in taxonomy
    ])

    def count(terms, hits):
        return F.size(F.filter(terms, lambda t: has_term(hits, t)))

    def score(h, c):
        plus = (
            3 * count(c["keywords"], h["name"]) + 2 * count(c["keywords"], h["head"])
            + count(c["keywords"], h["body"]) + 5 * count(c["titles"], h["name"])
        )
        minus = 4 * count(c["negatives"], h["name"]) + 2 * count(c["negatives"], h["head"])
        return F.greatest(plus - minus, F.lit(0)).cast("double")

    hits = F.struct(name_hits.alias("name"), head_hits.alias("head"), body_hits.alias("body"))
    return let(
        hits,
        lambda h: F.transform(
            cats,
            lambda c: F.struct(
                score(h, c).alias("score"), c["ord"].alias("ord"), c["category"].alias("category")
            ),
        ),
    )


def page_evidence(pages: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """One pass over the text: per page its size, terms, first and last characters.

    Read several times and far smaller than the text, so it is stored."""
    longest = max(map(len, terms))
    normal = computed(
        pages.select(DOC, "page", F.length(text).alias("n_chars"), text), _norm=normalise_terms(F.col(text))
    )
    found = normal.select(
        DOC, "page", "n_chars", term_hits(F.col("_norm"), terms).alias("hits"),
        F.left("_norm", F.lit(longest)).alias("_head"), F.right("_norm", F.lit(longest)).alias("_tail"),
    )
    with session_setting(pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", PAGES_PER_BATCH):
        return cut_lineage(found)


def body_terms(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_name, body_hits): terms anywhere in the joined normalised text."""
    inside = evidence.select(DOC, F.explode("hits").alias("term"))
    edges = evidence.where(F.col("_head") != "").select(DOC, "page", "_head", "_tail")
    seams = seams_of(edges, max(map(len, terms)), " ")
    across = seams.select(DOC, F.explode(term_hits(F.col("seam"), terms)).alias("term"))
    return inside.unionByName(across).groupBy(DOC).agg(F.collect_set("term").alias("body_hits"))


def score_documents(
    pages: DataFrame, filename: Column | None = None, taxonomy: list[Category] | None = None, text: str = "text"
) -> DataFrame:
    """(doc_name, scores) from (doc_name, page, text)."""
    taxonomy = taxonomy or load_taxonomy()
    terms = all_terms(taxonomy)
    filename = F.col(DOC) if filename is None else filename
    none = F.array().cast("array<string>")
    evidence = page_evidence(pages, terms, text)
    docs = (
        doc_heads(pages, text, fixed.HEAD_CHARS, sizes=evidence)
        .join(body_terms(evidence, terms), DOC, "left")
        .withColumn("_name_hits", term_hits(normalise_terms(filename), terms))
        .withColumn("_head_hits", term_hits(normalise_terms(F.col("head")), terms))
    )
    scores = category_scores_column(
        F.col("_name_hits"), F.col("_head_hits"), F.coalesce("body_hits", none), taxonomy
    )
    return computed(docs, scores=scores).select(DOC, "scores")


def category_scores(pages: DataFrame, **kw) -> DataFrame:
    """(doc_name, category, score) with every category, also those at zero."""
    scored = score_documents(pages, **kw)
    return scored.select(DOC, F.explode("scores").alias("s")).select(DOC, "s.category", "s.score")


def detect_category(pages: DataFrame, **kw) -> DataFrame:
    """(doc_name, category, score, second, confidence, low_confidence)."""
    ranked = let(
        F.col("scores"),
        lambda s: F.array_sort(F.transform(s, lambda x: F.struct(-x["score"], x["ord"], x["category"].alias("c")))),
    )
    top = score_documents(pages, **kw).select(DOC, let(
        ranked,
        lambda r: F.struct(
            r[0]["c"].alias("category"),
            (-r[0]["col1"]).alias("score"),
            F.coalesce(-F.get(r, F.lit(1))["col1"], F.lit(0.0)).alias("second"),
        ),
    ).alias("t")).select(DOC, "t.*")
    raw = F.coalesce(F.try_divide(F.col("score") - F.col("second"), F.col("score") + F.col("second")), F.lit(0.0))
    hit = F.col("score") > 0
    return top.select(
        DOC,
        F.when(hit, F.col("category")).otherwise("GENERAL").alias("category"),
        F.col("score"),
        F.col("second"),
        F.when(hit, F.bround(raw, 3)).otherwise(F.lit(0.0)).alias("confidence"),
        (hit & (raw < fixed.LOW_CONFIDENCE)).alias("low_confidence"),
    )
