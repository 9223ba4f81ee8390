"""Table queries. Spec tables are built from parts and suppliers, so the
expected rows are plain projections of those tables."""
from pyspark.sql import functions as F

from docmill import fixed
from docmill.checks.common import (
    WS_RE, collapse_sql, documents, label_sql, lines_sql, sql_text, strip_sql, table, values_sql,
)
from docmill.functions import labels
from docmill.functions.text import chunk_id, clean_cell_value, clean_metric_name
from docmill.operators import tables as tb
from docmill.operators.chunk import chunk_pages, spec_text
from docmill.sources.documents import spread

NL = "chr(10)"


# --- labels and codes --------------------------------------------------------

# per part: its own words next to words with a fixed meaning
_LABELS = [
    "p_name", "p_brand", "p_type", "'Model'", "' order  information '", "'Part-Number'", "'Performance'",
    "'power:'", "'Col' || p_size", "'col'", "'N/A'", "'--'", "''", "'tbd '", "'Yes'", "'optional!'",
    "p_size || ' Gbps'", "'Rate ' || p_size", "p_name || ' ' || p_size", "'FIM-7' || lpad(p_size::VARCHAR, 3, '0') || 'F'",
    "'fpm-123-2-DC'", "'FIM-12'", "'+-: -'", "'---'",
]


def _exploded(spark, folder, columns, exprs):
    part = spread(table(spark, folder, "part"))
    texts = F.array(*[F.expr(e.replace("::VARCHAR", "::STRING").replace("chr(10)", "'\\n'")) for e in exprs])
    return part.select(*columns, F.posexplode(texts).alias("n", "label"))


def _union_sql(columns, exprs):
    return "SELECT " + ", ".join(columns) + ", unnest(range(0, " + str(len(exprs)) + "))::INT AS n, unnest([" + \
        ", ".join(e for e in exprs) + "]) AS label FROM part"


def label_predicates(spark, folder):
    df = _exploded(spark, folder, ["p_partkey"], _LABELS)
    c = F.col("label")
    none = F.array().cast("array<string>")
    return df.select(
        "p_partkey", "n", "label",
        labels.is_generic_header(c).alias("generic"),
        labels.is_section_label(c).alias("section"),
        labels.is_component_code(c).alias("component"),
        labels.is_placeholder(c).alias("placeholder"),
        labels.is_blank(c).alias("blank"),
        labels.is_separator_cell(c).alias("separator"),
        labels.is_spec_value(c).alias("spec_value"),
        labels.is_metric_label(c, lambda s: F.filter(none, lambda m: m == s)).alias("metric_label"),
    )


def metric_sql(x):
    return strip_sql(f"regexp_replace({collapse_sql(strip_sql(x))}, '[ ,]+[\\p{{Nd}}, ]+$', '')")


def value_sql(x):
    return strip_sql(f"regexp_replace({collapse_sql(strip_sql(x))}, '[ ,]+[\\p{{Nd}},]+$', '')")


def _placeholder_sql(x):
    return f"regexp_matches({x}, '^(?i:col)\\p{{Nd}}+$')"


LABELS_SQL = f"""WITH l AS ({_union_sql(['p_partkey'], _LABELS)}),
 s AS (SELECT *, {strip_sql('label')} AS t, {metric_sql('label')} AS m FROM l)
SELECT p_partkey, n, label,
  {label_sql('label')} IN {values_sql(fixed.GENERIC_HEADERS)} AS generic,
  {label_sql('label')} IN {values_sql(fixed.SECTION_LABELS)} AS section,
  regexp_matches(t, '^(?i:F(IM|PM|AN|AC|SW)-[0-9]{{3,5}}[A-Z]{{0,3}}(-[0-9]{{1,2}})?(-DC)?)$') AS component,
  {_placeholder_sql('t')} AS placeholder,
  lower(label) IN {values_sql(fixed.BLANK_VALUES)} AS blank,
  regexp_matches(label, '^[-:+{WS_RE}]+$') AS separator,
  NOT {_placeholder_sql('t')} AND lower(t) NOT IN {values_sql(fixed.BLANK_VALUES)}
    AND (regexp_matches(t, '[0-9]') OR {label_sql('t')} IN {values_sql(fixed.WORDED_VALUES)}) AS spec_value,
  NOT {_placeholder_sql('m')} AND lower(m) NOT IN {values_sql(fixed.BLANK_VALUES)}
    AND {label_sql('m')} NOT IN {values_sql(fixed.GENERIC_HEADERS + fixed.SECTION_LABELS)}
    AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 3
    AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(m, '[^0-9]', '', 'g')) AS metric_label
FROM s"""

_VALUES = [
    "p_size || ',000'", "'1' || ',' || p_size", "p_size || ' / ' || p_size", "p_name || ' 6'", "p_name || ', 1, 2'",
    "' ' || p_brand || '   x '", "p_type || ' 1,2 3'", "p_size || ' Gbps'", "'a' || chr(10) || 'b 7'", "p_name",
]


def clean_values(spark, folder):
    df = _exploded(spark, folder, ["p_partkey"], _VALUES)
    return df.select(
        "p_partkey", "n", clean_metric_name(F.col("label")).alias("metric"), clean_cell_value(F.col("label")).alias("value")
    )


_CODES = [
    "'FG-' || (1000 + p_size) || 'F'", "'FG-' || (1000 + p_size) || 'F-2-DC'", "'SHA-' || (200 + p_size)",
    "'AES 256'", "p_size || 'W'", "'EN 55022'", "'PA-3200'", "'fg-7000f'", "'PA-' || (400 + p_size)",
    "'BIG-IP i' || (5000 + p_size)", "'r' || (5000 + p_size)", "'SRX-' || (1000 + p_size)", "'AB-12'", "'A-100'",
    "'ABCDEF-' || (10000 + p_size) || 'XYZ-DC'", "'ABCDEFG-100'", "p_brand", "'DAT-R22'", "'RS-232'", "'TPM-200'",
    "'DS-123456'", "'XX123456'", "''", "'FIM-' || (1000 + p_size) || 'E'",
]


def valid_model_codes(spark, folder):
    df = _exploded(spark, folder, ["p_partkey"], _CODES)
    c = F.col("label")
    return df.select(
        "p_partkey", "n", "label", labels.is_valid_model(c).alias("valid"),
        c.rlike(fixed.BLOCKED_MODEL).alias("blocked"), c.rlike(fixed.BLOCKED_CELL).alias("blocked_cell"),
    )


# fixed values, in the order of fixed.BLOCKED_MODEL
BLOCKED_SQL = "^(" + "|".join([
    "[0-9]{1,4}[WV]$",
    r"EN\s?[0-9]+",
    r"IEC\s?[0-9]+",
    r"[A-Z]{1,3}\s[0-9]{5}",
    "[A-Z]{2,3}[0-9]{6,}",
    r"AES[-\s]?[0-9]+",
    r"SHA[-\s]?[0-9]+",
    "NAT[0-9]{2}",
    "RS-232",
    "ICES-[0-9]+",
    r"HTTP\s?[0-9]+",
    "[0-9]+[GK]$",
    *fixed.PORT_TYPES,
    *fixed.PART_TYPES,
    r"DAT[-\s]?R?[0-9]+",
]) + ")"
FULL_SQL = (
    r"^(F[GPIM]{1,3}-[0-9]{3,5}[A-Z]{0,4}(-[0-9]{1,2})?(-DC)?|PA-[0-9]{3,5}[A-Z]{0,2}|(BIG-IP\s+)?[ir][0-9]{4,5}"
    r"|[A-Z]{2,6}-[0-9]{3,5}[A-Z]{0,3}(-DC)?)$"
)
VALID_SQL = f"""WITH l AS ({_union_sql(['p_partkey'], _CODES)})
SELECT p_partkey, n, label,
  length(label) >= 4 AND regexp_matches(label, '[0-9]') AND NOT regexp_matches(label, '{BLOCKED_SQL}', 'i')
    AND lower(label) NOT IN ('fg-7000f', 'pa-3200') AND regexp_matches(label, '{FULL_SQL}', 'i') AS valid,
  regexp_matches(label, '{BLOCKED_SQL}', 'i') AS blocked,
  regexp_matches(label, '^((AES|SHA)[-\\s]?[0-9]+$|[0-9]+[GK]$|[0-9]{{1,4}}[WV]$|(EN|IEC)\\s?[0-9]+)', 'i') AS blocked_cell
FROM l"""


# --- Markdown parsing --------------------------------------------------------

def _cells(df, parsed):
    rows = F.concat(F.array("t.headers"), F.col("t.rows"))
    return (
        df.select("doc_id", parsed.alias("t")).where(F.size("t.headers") > 0)
        .select("doc_id", F.posexplode(rows).alias("row_no", "cells"))
        .select("doc_id", "row_no", F.posexplode("cells").alias("col_no", "cell"))
    )


def markdown_parse(spark, folder):
    """Pipe lines of documents as tables, and each with a rule as second line."""
    docs = documents(spark, folder)
    ruled = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.concat(
        F.lit("[TABLE]\nA | B |\n-- | :-: | + | \n"), F.col("text"), F.lit("\n| | |\n|x||y|\n[/TABLE]")).alias("text"))
    both = docs.select("doc_id", "text").unionByName(ruled)
    return _cells(both, tb.parse_table(F.col("text")))


def markdown_parse_to_header(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.concat(
        F.lit("|A | B | C|\n| | -- | |\n"), F.col("text"), F.lit("\n|| \nx|y\n1|2|3|4|5|")).alias("text"))
    return _cells(docs, tb.parse_table_to_header(F.col("text")))


PARSE_SQL = f"""WITH d AS (
  SELECT doc_id, text FROM documents UNION ALL
  SELECT -doc_id - 1, '[TABLE]' || {NL} || 'A | B |' || {NL} || '-- | :-: | + | ' || {NL} || text || {NL} || '| | |' || {NL} || '|x||y|' || {NL} || '[/TABLE]' FROM documents),
 ln AS (SELECT doc_id, {strip_sql('l')} AS l, i FROM (
   SELECT doc_id, unnest({lines_sql("replace(replace(text, '[TABLE]', ''), '[/TABLE]', '')")}) AS l,
     generate_subscripts({lines_sql("replace(replace(text, '[TABLE]', ''), '[/TABLE]', '')")}, 1) AS i FROM d) WHERE contains(l, '|')),
 rw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r,
          list_transform(string_split(trim(l, '|'), '|'), lambda c: {strip_sql('c')}) AS cells FROM ln),
 sized AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS width, count(*) OVER (PARTITION BY doc_id) AS n FROM rw),
 flag AS (SELECT *, r = 2 AND len(list_filter(cells, lambda c: c <> '')) > 0
            AND len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^[-:+{WS_RE}]+$'))) = 0 AS rule FROM sized WHERE n >= 2),
 kept AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1)::INT AS row_no, cells, width FROM flag WHERE NOT rule)
SELECT doc_id, row_no, c::INT AS col_no, coalesce(cells[c + 1], '') AS cell FROM kept, LATERAL (SELECT unnest(range(0, width)) AS c)"""

TO_HEADER_SQL = f"""WITH d AS (
  SELECT doc_id, '|A | B | C|' || {NL} || '| | -- | |' || {NL} || text || {NL} || '|| ' || {NL} || 'x|y' || {NL} || '1|2|3|4|5|' AS text FROM documents),
 ln AS (SELECT doc_id, {strip_sql('l')} AS l, i FROM (
   SELECT doc_id, unnest({lines_sql('text')}) AS l, generate_subscripts({lines_sql('text')}, 1) AS i FROM d) WHERE contains(l, '|')),
 rw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r,
          list_transform(string_split(regexp_replace(regexp_replace(l, '^\\|', ''), '\\|$', ''), '|'), lambda c: {strip_sql('c')}) AS cells FROM ln),
 kept AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1)::INT AS row_no, cells FROM rw WHERE r <> 2)
SELECT doc_id, row_no, c::INT AS col_no, coalesce(cells[c + 1], '') AS cell FROM kept, LATERAL (SELECT unnest(range(0, 3)) AS c)"""


def header_contains(spark, folder):
    part = table(spark, folder, "part")
    text = F.expr("concat('Spec | FG-', p_size, 'F | ', p_brand, '\\n--- | --- | ---\\nSize | 1 | 2')")
    return part.where(tb.any_header_contains(tb.parse_table(text)["headers"], "FG-1")).select("p_partkey")


# --- spec tables -------------------------------------------------------------

GROUP = 4


def _part_groups(spark, folder):
    """Four neighbouring parts make a table; a brand is a document."""
    part = table(spark, folder, "part").withColumn("grp", F.floor(F.col("p_partkey") / GROUP))
    return part.withColumn("code", F.concat(F.lit("FG-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")))


def _sheet(df, line):
    """One table per group: rows joined in part order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda s: s["l"]), "\n")


def _row(name, values):
    return F.concat(F.lit(name), *[F.concat(F.lit(" | "), v) for v in values])


def column_sheets(spark, folder):
    """Metrics down, models across."""
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "code", "p_size", "p_brand", "p_type")))
    g = _part_groups(spark, folder).groupBy("grp").agg(items.alias("i"))

    def across(name, field):
        return F.concat(F.lit(name), F.lit(" | "), F.array_join(F.transform("i", field), " | "))

    text = F.concat_ws(
        "\n", F.lit("[TABLE]"), across("Specification", lambda s: s["code"]),
        F.concat(F.lit("--- | "), F.array_join(F.transform("i", lambda s: F.lit("---")), " | ")),
        across("Size rating", lambda s: s["p_size"].cast("string")),
        across("Performance", lambda s: F.lit("n/a")),
        across("Brand name 2", lambda s: s["p_brand"]),
        across("Type class", lambda s: F.lower(s["p_type"])),
        across("Model", lambda s: F.lit("77")),
        F.lit("[/TABLE]"),
    )
    return g.select(
        F.lit("columns.pdf").alias("doc_name"), F.col("grp").alias("page"), F.lit(0).alias("seg"), text.alias("text")
    ), _part_groups(spark, folder).select(F.lit("columns.pdf").alias("doc_name"), F.col("code").alias("model"))


def row_sheets(spark, folder):
    """Suppliers down, metrics across. A table of one supplier has no specs: one
    row of models makes no row-oriented table."""
    s = table(spark, folder, "supplier").withColumn("grp", F.floor(F.col("s_suppkey") / GROUP)).withColumn(
        "code", F.concat(F.lit("PA-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))
    )
    line = F.concat_ws(" | ", "code", F.col("s_nationkey").cast("string"), F.lit("-"), F.floor("s_acctbal").cast("string"))
    rows = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda x: x["l"]), "\n")
    text = F.concat(
        F.lit("[TABLE]\nModel | Nation index | Notes | Account level\n--- | --- | --- | ---\n"), rows, F.lit("\n[/TABLE]")
    )
    g = s.groupBy("grp").agg(text.alias("text"))
    return g.select(
        F.lit("rows.pdf").alias("doc_name"), F.col("grp").alias("page"), F.lit(0).alias("seg"), "text"
    ), s.select(F.lit("rows.pdf").alias("doc_name"), F.col("code").alias("model"))


def headerless_sheets(spark, folder):
    """model | value | metric, from the first line on."""
    line = F.concat_ws(" | ", "code", F.concat(F.col("p_size").cast("string"), F.lit(" mm")),
                       F.concat(F.lit("Outer "), F.regexp_replace("p_name", " .*", ""), F.lit(" extent (typ)*")))
    g = _part_groups(spark, folder).groupBy("grp").agg(_sheet(None, line).alias("rows"))
    text = F.concat(F.lit("[TABLE]\n"), F.regexp_replace("rows", r"^([^\n]*)", "$1\n--- | --- | ---"), F.lit("\n[/TABLE]"))
    return g.select(
        F.lit("headerless.pdf").alias("doc_name"), F.col("grp").alias("page"), F.lit(0).alias("seg"), text.alias("text")
    ), _part_groups(spark, folder).select(F.lit("headerless.pdf").alias("doc_name"), F.col("code").alias("model"))


def grouped_sheets(spark, folder):
    """Models are named in the prose as A/B pairs, the table has no model cells.
    Of an incomplete group the prose names no pairs, so its table has no specs."""
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "code", "p_size")))
    g = _part_groups(spark, folder).groupBy("grp").agg(items.alias("i"), F.count(F.lit(1)).alias("n"))

    def code(k):
        return F.get("i", F.lit(k))["code"]

    def size(k):
        return F.coalesce(F.get("i", F.lit(k))["p_size"].cast("string"), F.lit("-"))

    pairs = F.concat(code(0), F.lit("/\n"), code(1), F.lit("\n"), code(2), F.lit(" / "), code(3), F.lit("\n\n"))
    single = F.concat(F.array_join(F.transform("i", lambda s: s["code"]), " and "), F.lit("\n\n"))
    prose = F.when(F.col("n") == GROUP, pairs).otherwise(single)
    text = F.concat(
        F.lit("[TABLE]\nGeneral data |  | \n--- | --- | ---\nOuter extent (typ) | "), size(0), F.lit(" mm | "), size(2),
        F.lit(" mm\nInner extent | "), size(1), F.lit(" mm | -\n[/TABLE]"),
    )
    return g.select(
        F.lit("grouped.pdf").alias("doc_name"), F.col("grp").alias("page"), F.lit(0).alias("seg"), text.alias("text"),
        F.concat(prose, text).alias("page_text"),
    ), _part_groups(spark, folder).select(F.lit("grouped.pdf").alias("doc_name"), F.col("code").alias("model"))


def _specs(sheets):
    def run(spark, folder):
        pages, models = sheets(spark, folder)
        if "page_text" not in pages.columns:
            pages = pages.withColumn("page_text", F.col("text"))
        done = tb.table_specs(tb.attach_page_models(pages, models))
        return done.select("doc_name", "page", "strategy", F.posexplode("specs").alias("ord", "s")).select(
            "doc_name", "page", "strategy", "ord", "s.*"
        )
    return run


def spec_dispatch(spark, folder):
    """How many tables of each shape took which strategy."""
    out = None
    for sheets in (column_sheets, row_sheets, headerless_sheets, grouped_sheets):
        pages, models = sheets(spark, folder)
        if "page_text" not in pages.columns:
            pages = pages.withColumn("page_text", F.col("text"))
        part = tb.table_specs(tb.attach_page_models(pages, models)).groupBy("doc_name", "strategy").agg(
            F.count(F.lit(1)).alias("tables")
        )
        out = part if out is None else out.unionByName(part)
    return out


_CODE = "'FG-' || lpad(p_partkey::VARCHAR, 5, '0')"
_PART = f"p AS (SELECT *, p_partkey // {GROUP} AS grp, {_CODE} AS code, p_partkey % {GROUP} AS k, count(*) OVER (PARTITION BY p_partkey // {GROUP}) AS n FROM part)"
_ORD = "(row_number() OVER (PARTITION BY page ORDER BY {}) - 1)::INT AS ord"

COLUMN_SQL = f"""WITH {_PART}, s AS (
  SELECT grp AS page, 1 AS m, p_partkey, code AS model, 'Size rating' AS spec_name, p_size::VARCHAR AS value FROM p UNION ALL
  SELECT grp, 2, p_partkey, code, 'Brand name', p_brand FROM p UNION ALL
  SELECT grp, 3, p_partkey, code, 'Type class', lower(p_type) FROM p)
SELECT 'columns.pdf' AS doc_name, page, 'column' AS strategy, {_ORD.format('m, p_partkey')}, model, spec_name, value FROM s"""

ROW_SQL = f"""WITH p AS (SELECT *, s_suppkey // {GROUP} AS grp, 'PA-' || lpad(s_suppkey::VARCHAR, 5, '0') AS code,
    count(*) OVER (PARTITION BY s_suppkey // {GROUP}) AS n FROM supplier), s AS (
  SELECT grp AS page, s_suppkey, 1 AS m, code AS model, 'Nation index' AS spec_name, s_nationkey::VARCHAR AS value FROM p WHERE n > 1 UNION ALL
  SELECT grp, s_suppkey, 2, code, 'Account level', floor(s_acctbal)::BIGINT::VARCHAR FROM p WHERE n > 1)
SELECT 'rows.pdf' AS doc_name, page, 'row' AS strategy, {_ORD.format('s_suppkey, m')}, model, spec_name, value FROM s"""

HEADERLESS_SQL = f"""WITH {_PART}
SELECT 'headerless.pdf' AS doc_name, grp AS page, 'headerless' AS strategy, k::INT AS ord, code AS model,
  'Outer ' || string_split(p_name, ' ')[1] || ' extent (typ)*' AS spec_name, p_size || ' mm' AS value FROM p"""

GROUPED_SQL = f"""WITH {_PART},
 own AS (SELECT a.grp AS page, 1 AS m, b.k, b.code AS model, 'Outer extent (typ)' AS spec_name, a.p_size || ' mm' AS value
         FROM p a JOIN p b ON a.grp = b.grp AND a.k = 2 * (b.k // 2) WHERE a.n = {GROUP}
         UNION ALL
         SELECT a.grp, 2, b.k, b.code, 'Inner extent', a.p_size || ' mm'
         FROM p a JOIN p b ON a.grp = b.grp AND a.k = 1 AND b.k < 2 WHERE a.n = {GROUP})
SELECT 'grouped.pdf' AS doc_name, page, 'contextual' AS strategy, {_ORD.format('m, k')}, model, spec_name, value FROM own"""

DISPATCH_SQL = f"""WITH {_PART}, g AS (SELECT grp, any_value(n) AS n FROM p GROUP BY grp),
 s AS (SELECT s_suppkey // {GROUP} AS grp, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'columns.pdf' AS doc_name, 'column' AS strategy, count(*) AS tables FROM g UNION ALL
SELECT 'rows.pdf', CASE WHEN n > 1 THEN 'row' ELSE 'column' END, count(*) FROM s GROUP BY 2 UNION ALL
SELECT 'headerless.pdf', 'headerless', count(*) FROM g UNION ALL
SELECT 'grouped.pdf', CASE WHEN n = {GROUP} THEN 'contextual' ELSE 'none' END, count(*) FROM g GROUP BY 2"""

_BETWEEN = ["' / '", "' '", "'\\\\'", "'\\n'", "'/\\n'", "' | '", "'|/'", "' and '", "' or/and '"]
RUN = 9


def model_group_runs(spark, folder):
    """Codes of nine neighbouring parts, each named twice, with slashes, back slashes,
    pipes, line breaks or words between them as the parts' sizes have it."""
    part = table(spark, folder, "part").withColumns({"grp": F.floor(F.col("p_partkey") / RUN), "code": F.concat(F.lit("FG-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))})
    between = F.element_at(F.array(*[F.expr(b) for b in _BETWEEN]), (F.col("p_size") % len(_BETWEEN) + 1).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "code", between.alias("b"))))
    g = part.groupBy("grp").agg(items.alias("i"))
    once = F.array_join(F.transform("i", lambda s: F.concat(s["code"], s["b"])), "")
    twice = F.array_join(F.transform(F.reverse("i"), lambda s: F.concat(F.lower(s["code"]), s["b"])), "")
    # a longer code is another one
    groups = tb.model_groups(F.concat(once, F.lit("FG-1 x "), twice), F.transform("i", lambda s: s["code"]))
    return g.select("grp", F.posexplode(groups).alias("ord", "g")).select("grp", "ord", F.array_join("g", ",").alias("models"))


_BETWEEN_SQL = [b.replace("\\\\", "\\").replace("\\n", "' || chr(10) || '") for b in _BETWEEN]
RUNS_SQL = rf"""WITH p AS (SELECT *, p_partkey // {RUN} AS grp, {_CODE} AS code, [{", ".join(_BETWEEN_SQL)}][p_size % {len(_BETWEEN)} + 1] AS b FROM part),
t AS (SELECT grp, string_agg(code || b, '' ORDER BY p_partkey) || 'FG-1 x ' || string_agg(lower(code) || b, '' ORDER BY p_partkey DESC) AS t FROM p GROUP BY grp),
k AS (SELECT grp, i, upper(w[i]) AS w FROM (SELECT grp, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT grp, regexp_extract_all(t, '[Ff][Gg]-[0-9]{{5}}|[/\\]|\||
') AS w FROM t))),
c AS (SELECT *, count(*) FILTER (w = chr(10)) OVER o AS line, count(*) FILTER (w IN ('|', chr(10))) OVER o AS cell, count(*) FILTER (w IN ('/', chr(92))) OVER o AS slashes
  FROM k WINDOW o AS (PARTITION BY grp ORDER BY i)),
m AS (SELECT * FROM c WHERE w LIKE 'FG-%'),
h AS (SELECT *, slashes = lag(slashes) OVER o AS apart, line IS DISTINCT FROM lag(line) OVER o AS other_line, cell IS DISTINCT FROM lag(cell) OVER o AS other_cell
  FROM m WINDOW o AS (PARTITION BY grp ORDER BY i)),
r AS (
  SELECT grp, i, w, 0 AS place, 0 AS kind, sum(coalesce(apart, true)::INT) OVER o AS run FROM h WINDOW o AS (PARTITION BY grp ORDER BY i) UNION ALL
  SELECT grp, i, w, line + 1, 1, sum((coalesce(apart, true) OR other_line)::INT) OVER o FROM h WINDOW o AS (PARTITION BY grp ORDER BY i) UNION ALL
  SELECT grp, i, w, line + 1, 2, sum((coalesce(apart, true) OR other_cell)::INT) OVER o FROM h WINDOW o AS (PARTITION BY grp ORDER BY i)),
g AS (SELECT grp, place, kind, min(i) AS first, string_agg(w, ',' ORDER BY i) AS models FROM r GROUP BY grp, place, kind, run HAVING count(*) > 1),
f AS (SELECT grp, models, min((place, kind, first)) AS place FROM g GROUP BY grp, models)
SELECT grp, (row_number() OVER (PARTITION BY grp ORDER BY place) - 1)::INT AS ord, models FROM f"""


LONG = 16


def long_sheets(spark, folder):
    """Sixteen parts per table. Of every three tables one names its models in the
    eighth row, one in the ninth, too late to be looked at, and one has a row per
    part. A cell names two models, of which the longer comes first."""
    part = table(spark, folder, "part").withColumns({
        "grp": F.floor(F.col("p_partkey") / LONG), "short": F.concat(F.lit("AB-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")),
        "long": F.concat(F.lit("AB-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("F")),
    })
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "short", "long", "p_size")))
    g = part.groupBy("grp").agg(items.alias("i"))

    def across(name, field):
        return F.concat(F.lit(name), F.lit(" | "), F.array_join(F.transform("i", field), " | "))

    both = lambda s: F.concat(s["short"], F.lit(" "), s["long"])
    blank = across("Notes", lambda s: F.lit("-"))
    head = [across("Table of parts", lambda s: F.lit("-")), F.concat(F.lit("--- | "), F.array_join(F.transform("i", lambda s: F.lit("---")), " | "))]
    values = [across("Outer extent", lambda s: s["p_size"].cast("string")), across("Inner extent", lambda s: F.concat(s["p_size"].cast("string"), F.lit(" mm")))]
    down = F.array_join(F.transform("i", lambda s: F.concat(both(s), F.lit(" | "), s["p_size"].cast("string"), F.lit(" | x"), s["p_size"].cast("string"))), "\n")
    sheet = lambda *rows: F.concat_ws("\n", F.lit("[TABLE]"), *rows, F.lit("[/TABLE]"))
    shape = F.col("grp") % 3
    text = (
        F.when(shape == 0, sheet(*head, *[blank] * 6, across("Code", both), *values))
        .when(shape == 1, sheet(*head, *[blank] * 7, across("Code", both), *values))
        .otherwise(sheet(F.lit("Model | Extent | Shape"), F.lit("--- | --- | ---"), down))
    )
    models = part.select(F.lit("long.pdf").alias("doc_name"), F.explode(F.array("short", "long")).alias("model"))
    return g.select(F.lit("long.pdf").alias("doc_name"), F.col("grp").alias("page"), F.lit(0).alias("seg"), text.alias("text")), models


LONG_SQL = f"""WITH p AS (SELECT *, p_partkey // {LONG} AS grp, 'AB-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS short, 'AB-' || lpad(p_partkey::VARCHAR, 5, '0') || 'F' AS long,
   count(*) OVER (PARTITION BY p_partkey // {LONG}) AS size FROM part),
 f AS (SELECT grp, max_by(long, p_partkey) AS last, min_by(short, p_partkey) AS first FROM p GROUP BY grp),
 m AS (SELECT p.*, b.n AS which, CASE WHEN b.n = 0 THEN long ELSE short END AS model FROM p, (SELECT unnest([0, 1]) AS n) b),
 s AS (SELECT grp, 'column' AS strategy, 1 AS a, p_partkey AS b, which AS c, model, 'Outer extent' AS spec_name, p_size::VARCHAR AS value FROM m WHERE grp % 3 = 0 UNION ALL
   SELECT grp, 'column', 2, p_partkey, which, model, 'Inner extent', p_size || ' mm' FROM m WHERE grp % 3 = 0 UNION ALL
   -- the end tag between the page and the table makes alternatives of the models beside it
   SELECT p.grp, 'contextual', a, p_partkey, b.n, CASE WHEN b.n = 0 THEN f.last ELSE f.first END, ['Code', 'Outer extent', 'Inner extent'][a],
     [short || ' ' || long, p_size::VARCHAR, p_size || ' mm'][a] FROM p JOIN f USING (grp), (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([0, 1]) AS n) b WHERE p.grp % 3 = 1 UNION ALL
   SELECT grp, 'row', p_partkey, 1, which, model, 'Extent', p_size::VARCHAR FROM m WHERE grp % 3 = 2 AND size > 1 UNION ALL
   SELECT grp, 'row', p_partkey, 2, which, model, 'Shape', 'x' || p_size FROM m WHERE grp % 3 = 2 AND size > 1)
SELECT 'long.pdf' AS doc_name, grp AS page, strategy, (row_number() OVER (PARTITION BY grp ORDER BY a, b, c) - 1)::INT AS ord, model, spec_name, value FROM s"""


def known_model_sets(spark, folder):
    """Models that may stand in tables, longest first: no components, no families."""
    size = F.col("p_size").cast("string")
    codes = F.array(
        F.concat(F.lit("AB-"), F.col("p_partkey").cast("string")), F.concat(F.lit("FIM-70"), size, F.lit("F")), F.concat(F.lit("PA-1"), size, F.lit("0")),
        F.concat(F.lit("AB-"), F.col("p_partkey").cast("string")), F.concat(F.lit("CD-"), size, F.lit("1")), F.concat(F.lit("XY-1"), size, F.lit("0")), F.concat(F.lit("fpm-1"), size),
    )
    family = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("pa-1"), size, F.lit("0")))).otherwise(F.array().cast("array<string>"))
    part = table(spark, folder, "part").select("p_partkey", codes.alias("m"), F.array(F.concat(F.lit("cd-"), size, F.lit("1"))).alias("c"), family.alias("f"))
    return part.select("p_partkey", F.array_join(tb.known_models(F.col("m"), F.col("c"), F.col("f")), ",").alias("known"))


KNOWN_SQL = """WITH p AS (SELECT p_partkey, ['AB-' || p_partkey, 'FIM-70' || p_size || 'F', 'PA-1' || p_size || '0', 'CD-' || p_size || '1', 'XY-1' || p_size || '0', 'fpm-1' || p_size] AS m,
   ['CD-' || p_size || '1', CASE WHEN p_size % 2 = 0 THEN 'PA-1' || p_size || '0' END] AS gone FROM part),
 e AS (SELECT p_partkey, gone, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM p)
SELECT p_partkey, string_agg(x, ',' ORDER BY length(x) DESC, i) AS known FROM e
WHERE NOT coalesce(list_contains(gone, upper(x)), false) AND NOT regexp_matches(x, '^F(IM|PM|AN|AC|SW)-[0-9]{3,5}[A-Z]{0,3}(-[0-9]{1,2})?(-DC)?$', 'i') GROUP BY p_partkey"""


def spec_chunk_text(spark, folder):
    part = table(spark, folder, "part").withColumn("v", F.col("p_size").cast("string"))
    text = spec_text(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit("Size"), F.col("v"), F.col("p_type"))
    return part.select("p_partkey", text.alias("text"), chunk_id(F.col("p_brand"), F.col("p_partkey"), text).alias("chunk_id"))


SPEC_TEXT_SQL = """WITH t AS (SELECT p_partkey, p_brand, 'Vendor: ' || p_brand || chr(10) || 'Family: ' || p_type || chr(10) || 'Model: ' || p_name
  || chr(10) || chr(10) || 'Feature: Size' || chr(10) || 'Value: ' || p_size || chr(10) || chr(10) || 'Context: ' || p_type AS text FROM part)
SELECT p_partkey, text, md5(p_brand || '|' || p_partkey || '|' || text) AS chunk_id FROM t"""

def sheet_chunks(spark, folder):
    """All chunks of one large file of spec tables: the table, then its spec rows."""
    sheets, models = column_sheets(spark, folder)
    info = sheets.select("doc_name").distinct().select(
        "doc_name", F.lit("Acme").alias("vendor"), F.lit("Wares").alias("product_family"), F.lit("NGFW").alias("category")
    )
    chunks = chunk_pages(sheets.select("doc_name", "page", "text"), info, "window", models=models)
    return chunks.select("page", "chunk_idx", "chunk_type", "chunk_id", "family", "display_family", "model", "spec_name", "spec_value", "text")


SHEET_SQL = f"""WITH {_PART},
 t AS (SELECT grp AS page, '[TABLE]' || chr(10) || 'Specification | ' || string_agg(code, ' | ' ORDER BY p_partkey)
    || chr(10) || '--- | ' || string_agg('---', ' | ')
    || chr(10) || 'Size rating | ' || string_agg(p_size::VARCHAR, ' | ' ORDER BY p_partkey)
    || chr(10) || 'Performance | ' || string_agg('n/a', ' | ')
    || chr(10) || 'Brand name 2 | ' || string_agg(p_brand, ' | ' ORDER BY p_partkey)
    || chr(10) || 'Type class | ' || string_agg(lower(p_type), ' | ' ORDER BY p_partkey)
    || chr(10) || 'Model | ' || string_agg('77', ' | ') || chr(10) || '[/TABLE]' AS text FROM p GROUP BY grp),
 a AS (SELECT page, -1 AS ord, '' AS model, NULL AS spec_name, NULL AS value, text FROM t UNION ALL
   SELECT page, ord, model, spec_name, value, 'Vendor: Acme' || chr(10) || 'Family: Wares' || chr(10) || 'Model: ' || model || chr(10) || chr(10)
     || 'Feature: ' || spec_name || chr(10) || 'Value: ' || value || chr(10) || chr(10) || 'Context: Acme Wares NGFW technical specification'
   FROM ({COLUMN_SQL}))
SELECT page, row_number() OVER (ORDER BY page, ord) - 1 AS chunk_idx, CASE WHEN ord < 0 THEN 'table_full' ELSE 'spec_row' END AS chunk_type,
  md5('columns.pdf|' || page || '|' || text) AS chunk_id, 'Wares' AS family, 'Wares' AS display_family, model, spec_name, value AS spec_value, text FROM a"""

QUERIES = {
    "sheet_chunks": (sheet_chunks, SHEET_SQL),
    "label_predicates": (label_predicates, LABELS_SQL),
    "clean_cell_values": (
        clean_values,
        f"WITH l AS ({_union_sql(['p_partkey'], _VALUES)}) SELECT p_partkey, n, {metric_sql('label')} AS metric, {value_sql('label')} AS value FROM l",
    ),
    "valid_model_codes": (valid_model_codes, VALID_SQL),
    "markdown_parse": (markdown_parse, PARSE_SQL),
    "markdown_parse_to_header": (markdown_parse_to_header, TO_HEADER_SQL),
    "header_contains": (header_contains, "SELECT p_partkey FROM part WHERE starts_with(p_size::VARCHAR, '1') OR contains(p_brand, 'FG-1')"),
    "spec_column_tables": (_specs(column_sheets), COLUMN_SQL),
    "spec_row_tables": (_specs(row_sheets), ROW_SQL),
    "spec_headerless": (_specs(headerless_sheets), HEADERLESS_SQL),
    "spec_grouped_headers": (_specs(grouped_sheets), GROUPED_SQL),
    "model_group_runs": (model_group_runs, RUNS_SQL),
    "spec_long_tables": (_specs(long_sheets), LONG_SQL),
    "known_model_sets": (known_model_sets, KNOWN_SQL),
    "spec_dispatch": (spec_dispatch, DISPATCH_SQL),
    "spec_chunk_text": (spec_chunk_text, SPEC_TEXT_SQL),
}
