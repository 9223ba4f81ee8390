"""Document metadata: vendor, product family, models, components.

Most signals live in a document's first characters and are column expressions
over a bounded head. Signals from the whole text are collected per page, plus
the matches that lie across page borders, and united per document.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill import fixed
from docmill.functions.labels import is_component_code, is_valid_model
from docmill.functions.text import collapse_ws, dashed_stem, let, lines, normalise_label, stem, strip
from docmill.operators.bitmaps import filtered
from docmill.operators.ordering import DOC, PAGE, first_pages, head_pages, join_pages, seams_of
from docmill.session import cut_lineage

HEAD = 5000
_SEAM = "\ue000"  # a private-use character stands for the page border
# A match holds at most 70 characters besides white space (the longest: a
# copyright line), so page edges are cut by these; white space counts nothing.
_SEAM_CHARS = 80
_BLANK = f"[{fixed.WS}{_SEAM}]"


def _all(c, pattern, group=1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _one(c, pattern, group=1) -> Column:
    return F.regexp_extract(c, pattern, group)


def _rstrip_marks(c) -> Column:
    return F.rtrim(c, F.lit(".,"))


# --- vendor ------------------------------------------------------------------

def _usable(name, low: int, high: int) -> Column:
    return (F.length(name) > low) & (F.length(name) < high) & ~name.isin(fixed.VENDOR_NOISE)


def _weighted(names, weight: int) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(weight).alias("weight")))


def head_vendor_signals(head) -> Column:
    """Array of (name, weight) from the first 2000 characters, copyright aside."""
    w = fixed.VENDOR_WEIGHTS

    def in_header(line):
        first = _one(line, fixed.PIPE_HEADER)
        return let(first, lambda p: let(
            F.struct(_one(p, fixed.BY).alias("by"), _one(p, fixed.TRADEMARK).alias("mark")),
            lambda s: F.struct(
                F.when(s["by"] != "", strip(s["by"])).otherwise(s["mark"]).alias("name"),
                F.when(s["by"] != "", F.lit(w["pipe_by"])).otherwise(F.lit(w["pipe_mark"])).alias("weight"),
            ),
        ))

    def build(h):
        headers = F.transform(F.slice(lines(h), 1, 15), lambda l: in_header(strip(l)))
        by = F.transform(_all(h, fixed.BY), lambda n: _rstrip_marks(strip(n)))
        return F.concat(
            F.filter(headers, lambda s: (s["name"] != "") & ~s["name"].isin(fixed.VENDOR_NOISE)),
            _weighted(F.filter(by, lambda n: _usable(n, 3, 50)), w["by"]),
            _weighted(F.filter(_all(h, fixed.TRADEMARK), lambda n: _usable(n, 2, 30)), w["mark"]),
            _weighted(F.filter(_all(h, fixed.POSSESSIVE), lambda n: _usable(n, 3, 30)), w["possessive"]),
        )

    return let(F.left(head, F.lit(2000)), build)


def copyright_names(text) -> Column:
    names = F.transform(_all(text, fixed.COPYRIGHT), lambda n: _rstrip_marks(strip(n)))
    return F.filter(names, lambda n: _usable(n, 3, 50))


def _first_chars(text) -> Column:
    """The start of a text up to its ``_SEAM_CHARS``-th character that isn't white space."""
    return _one(text, f"(?s)^(?:{_BLANK}*+.){{1,{_SEAM_CHARS}}}", 0)


def _last_chars(text) -> Column:
    return F.reverse(_first_chars(F.reverse(text)))


def _across(seams: DataFrame, pattern: str) -> DataFrame:
    """(doc_name, match): matches of ``pattern`` that contain the page border."""
    bridged = pattern.replace(f"[{fixed.WS}]", f"[{fixed.WS}{_SEAM}]")
    return seams.select(DOC, F.explode(_all(F.col("seam"), bridged, 0)).alias("match")).where(
        F.contains("match", F.lit(_SEAM))
    ).select(DOC, F.replace("match", F.lit(_SEAM), F.lit("\n")).alias("match"))


def vendor_candidates(facts: DataFrame, heads: DataFrame, seams: DataFrame) -> DataFrame:
    """(doc_name, name, weight, freq): best weight and number of mentions."""
    signals = heads.select(DOC, F.explode(head_vendor_signals(F.col("head"))).alias("s")).select(
        DOC, "s.name", "s.weight"
    )
    on_page = facts.select(DOC, F.explode("names").alias("name"))
    across = _across(seams.where(F.contains("seam", F.lit("©"))), fixed.COPYRIGHT).select(
        DOC, F.explode(copyright_names(F.col("match"))).alias("name")
    )
    marked = on_page.unionByName(across).withColumn("weight", F.lit(fixed.VENDOR_WEIGHTS["copyright"]))
    return signals.unionByName(marked).groupBy(DOC, "name").agg(
        F.max("weight").alias("weight"), F.count(F.lit(1)).alias("freq")
    )


def best_vendor(candidates: DataFrame) -> DataFrame:
    """(doc_name, vendor): by weight, mentions, length, then name."""
    rank = F.struct(-F.col("weight"), -F.col("freq"), -F.length("name"), F.col("name").alias("name"))
    return candidates.groupBy(DOC).agg(F.min(rank).getField("name").alias("vendor"))


def vendor_from_filename(filename) -> Column:
    def pick(s):
        words = F.filter(
            F.split(s, "-", -1),
            lambda p: (F.length(p) > 2) & ~p.rlike(r"^\p{Nd}+$") & ~p.isin(fixed.STEM_STOPWORDS),
        )
        out = None
        for part, vendor in fixed.STEM_VENDORS:
            test = F.contains(s, F.lit(part))
            if part == "palo-alto":
                test = test | F.startswith(s, F.lit("pa-"))
            out = F.when(test, vendor) if out is None else out.when(test, vendor)
        # title case: a letter after any non-letter is upper-cased
        title = lambda p: F.concat_ws("", F.transform(
            F.regexp_extract_all(p, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap
        ))
        return out.otherwise(F.when(F.size(words) > 0, title(F.get(words, F.lit(0)))).otherwise(stem(filename)))

    return let(dashed_stem(filename), pick)


# --- product family ----------------------------------------------------------

def family_from_filename(filename) -> Column:
    def pick(s):
        return F.coalesce(*[
            F.when(_one(s, p) != "", F.concat(F.lit(prefix), F.upper(_one(s, p)), F.lit(" Series")))
            for p, prefix in fixed.FAMILY_IN_STEM
        ], F.lit(""))

    return let(dashed_stem(filename), pick)


def family_from_text(text) -> Column:
    found = [F.nullif(strip(collapse_ws(_one(text, p))), F.lit("")) for p in fixed.FAMILY_IN_TEXT]
    return F.coalesce(*found, F.lit(""))


def _without_suffix(c) -> Column:
    return strip(F.regexp_replace(c, fixed.FAMILY_SUFFIX, ""))


def family_from_title(head, vendor) -> Column:
    """The first title-like line of the head, else part 2 of a pipe header."""

    def title(line):
        words = F.size(F.filter(F.split(collapse_ws(line), " "), lambda w: w != ""))
        shouting = (F.upper(line) == line) & (F.lower(line) != line) & ~F.contains(line, F.lit(" "))
        wanted = (
            ~((vendor != "") & (F.lower(line) == F.lower(vendor)))
            & ~normalise_label(line).isin(fixed.MARKETING_HEADINGS)
            & ~F.lower(line).isin(fixed.GENERIC_TITLES)
            & F.length(line).between(5, 69) & ~shouting & (words <= 7)
        )
        return let(
            _without_suffix(line),
            lambda t: F.when(wanted & (F.length(t) >= 4) & t.rlike(fixed.PRODUCT_TITLE), t),
        )

    def build(ls):
        titles = F.filter(F.transform(F.slice(ls, 1, 20), title), lambda t: t.isNotNull())
        headers = F.filter(
            F.transform(F.slice(ls, 1, 15), lambda l: _without_suffix(strip(_one(l, fixed.PIPE_HEADER, 2)))),
            lambda t: t != "",
        )
        return F.coalesce(F.get(titles, F.lit(0)), F.get(headers, F.lit(0)), F.lit(""))

    return let(F.filter(F.transform(lines(head), strip), lambda l: l != ""), build)


def product_family(family_text, vendor, filename) -> Column:
    named = F.nullif(family_from_filename(filename), F.lit(""))
    stated = F.nullif(family_from_text(F.left(family_text, F.lit(HEAD))), F.lit(""))
    titled = F.nullif(family_from_title(F.left(family_text, F.lit(600)), vendor), F.lit(""))
    return F.coalesce(named, stated, titled, F.lit("UNKNOWN"))


# --- codes -------------------------------------------------------------------

def product_codes(text) -> Column:
    return F.transform(_all(F.replace(text, F.lit("\n"), F.lit(" ")), fixed.CODE), strip)


def doc_id_prefixes(text) -> Column:
    return F.array_distinct(F.transform(_all(text, fixed.DOC_ID), F.upper))


def family_identifiers(head, family) -> Column:
    """Codes called a series, family or platform, and fixed designators."""

    def of(c):
        codes = F.transform(_all(c, fixed.CODE), lambda m: F.upper(strip(m)))
        named = F.transform(_all(c, fixed.CODE + fixed.FAMILY_TAIL), lambda m: F.upper(strip(m)))
        return F.concat(F.filter(codes, lambda m: m.isin(fixed.FAMILY_DESIGNATORS)), named)

    return F.array_sort(F.array_distinct(F.concat(of(family), of(F.left(head, F.lit(4000))))))


def code_counts(facts: DataFrame, seams: DataFrame) -> DataFrame:
    """(doc_name, code): distinct product codes of the joined text.

    Only a two-word code can cross a page border; it takes the place of the
    one-word code the next page would show on its own.
    """
    on_page = facts.select(DOC, F.explode("codes").alias("code")).withColumn("n", F.lit(1))
    two_words = _across(seams.where(F.col("seam").rlike("(?i)BIG-IP")), fixed.CODE)
    whole = two_words.select(DOC, F.explode(product_codes(F.col("match"))).alias("code"))
    alone = whole.select(DOC, F.regexp_extract("code", r"(\S+)$", 1).alias("code"))
    return (
        on_page.unionByName(whole.withColumn("n", F.lit(1)))
        .unionByName(alone.withColumn("n", F.lit(-1)))
        .groupBy(DOC, "code").agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
        .select(DOC, "code")
    )


def document_codes(facts: DataFrame, heads: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_name, model) and (doc_name, component) relations.

    ``heads`` has doc_name, head and product_family.
    """
    components = codes.where(is_component_code(F.col("code"))).select(DOC, F.col("code").alias("component"))
    flat = F.replace(F.col("head"), F.lit("\n"), F.lit(" "))
    taken = heads.select(DOC, F.explode(family_identifiers(flat, F.col("product_family"))).alias("upper"))
    prefixes = facts.select(DOC, F.explode("prefixes").alias("upper"))
    excluded = taken.unionByName(prefixes).distinct()
    models = (
        codes.where(~is_component_code(F.col("code")) & is_valid_model(F.col("code")))
        .withColumn("upper", F.upper("code"))
        .join(excluded, [DOC, "upper"], "left_anti")
        .select(DOC, F.col("code").alias("model"))
    )
    return models, components


def page_facts(pages: DataFrame) -> DataFrame:
    """One pass over the text: what each page contributes, as small arrays.

    Everything below reads this; the text is read once more, for the heads."""
    edge = F.translate("text", _SEAM, "\ufffd")
    return cut_lineage(pages.select(
        DOC, PAGE, F.length("text").alias("n_chars"),
        _first_chars(edge).alias("_head"), _last_chars(edge).alias("_tail"),
        product_codes(F.col("text")).alias("codes"),
        doc_id_prefixes(F.col("text")).alias("prefixes"),
        F.when(F.contains("text", F.lit("©")), copyright_names(F.col("text"))).alias("names"),
    ))


def fact_seams(facts: DataFrame) -> DataFrame:
    """Seams of the pages that hold more than white space."""
    edges = facts.where(F.col("_head") != "").select(DOC, PAGE, "_head", "_tail")
    return seams_of(edges, _SEAM_CHARS, _SEAM, last=_last_chars, size=lambda c: F.length(F.regexp_replace(c, _BLANK, "")))


def document_heads(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_name, head, family_text): the first characters of the joined pages,
    and the same behind a copy of the first three pages."""
    wanted = head_pages(facts, HEAD).withColumn("_in", F.lit("head")).unionByName(
        first_pages(facts, 3).withColumn("_in", F.lit("first"))
    ).groupBy(DOC, PAGE).agg(F.collect_set("_in").alias("_in"))
    wanted = cut_lineage(wanted)
    near = filtered(pages.select(DOC, PAGE, "text"), wanted, DOC, PAGE)
    texts = near.select(DOC, PAGE, F.left("text", F.lit(HEAD)).alias("_t")).join(wanted, [DOC, PAGE])
    # a page cut at HEAD already fills the family text, whatever comes behind it
    return texts.groupBy(DOC).agg(
        F.left(join_pages("_t", F.array_contains("_in", "head")), F.lit(HEAD)).alias("head"),
        join_pages("_t", F.array_contains("_in", "first")).alias("_first"),
    ).select(DOC, "head", F.left(F.concat_ws("\n", "_first", "head"), F.lit(HEAD)).alias("family_text"))


def doc_meta_relations(pages: DataFrame, filename: Column | None = None) -> dict[str, DataFrame]:
    """Relations ``docs``, ``models`` and ``components`` of raw pages.

    What several of them read is stored, so that pages are ordered for their seams once."""
    filename = F.col(DOC) if filename is None else filename
    facts = page_facts(pages)
    seams = cut_lineage(fact_seams(facts))
    heads = cut_lineage(document_heads(pages, facts))  # a few thousand characters per document
    vendors = cut_lineage(best_vendor(vendor_candidates(facts, heads, seams)))
    docs = (
        heads.join(vendors, DOC, "left")
        .withColumn("_stated", F.coalesce("vendor", F.lit("")))
        .withColumn("product_family", product_family(F.col("family_text"), F.col("_stated"), filename))
    )
    models, components = document_codes(facts, docs, cut_lineage(code_counts(facts, seams)))
    named = docs.select(
        DOC,
        F.when(F.col("_stated") != "", F.col("_stated")).otherwise(vendor_from_filename(filename)).alias("vendor"),
        F.col("product_family").alias("family"),
        "product_family",
        family_identifiers(F.col("head"), F.col("product_family")).alias("family_identifiers"),
        F.when(F.col("_stated") != "", "content").otherwise("filename_fallback").alias("source"),
    )
    return {"docs": named, "models": models, "components": components}


def extract_doc_meta(pages: DataFrame, filename: Column | None = None) -> DataFrame:
    """One row per document; models and components are sorted distinct codes."""
    return with_code_lists(doc_meta_relations(pages, filename))


def with_code_lists(parts: dict[str, DataFrame]) -> DataFrame:
    """The documents with their code lists. The relations hold distinct codes
    already; use those instead where a document may name very many."""
    none = F.array().cast("array<string>")
    models = parts["models"].groupBy(DOC).agg(F.array_sort(F.collect_set("model")).alias("models"))
    components = parts["components"].groupBy(DOC).agg(F.array_sort(F.collect_set("component")).alias("components"))
    return (
        parts["docs"].join(models, DOC, "left").join(components, DOC, "left")
        .select(
            DOC, "vendor", "family", "product_family",
            F.coalesce("models", none).alias("models"),
            F.coalesce("components", none).alias("components"),
            "family_identifiers", "source",
        )
    )
