"""Cleaning queries."""
from pyspark.sql import functions as F

from docmill import fixed
from docmill.checks.common import (
    PAGES_SQL, WORD_RE, WS_RE, documents, label_sql, lines_sql, pages, sql_text, strip_sql, text_map,
)
from docmill.functions.text import normalise_label, normalise_terms
from docmill.operators import clean

NOISE_SQL = rf"regexp_matches(l, '^[{WS_RE}\p{{Nd}}.\-_|]{{0,6}}$')"


def noise_free(x):
    return f"array_to_string(list_filter({lines_sql(x)}, lambda l: NOT {NOISE_SQL}), chr(10))"


def whitespace_sql(x):
    out = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    out = f"array_to_string(list_transform({lines_sql(out)}, lambda l: rtrim(l, {sql_text(fixed.WS_CHARS)})), chr(10))"
    return strip_sql(f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')")


def bullets_sql(x):
    return f"regexp_replace({x}, '(?m)^[{WS_RE}]*[{fixed.BULLETS}][{WS_RE}]*', '- ', 'g')"


def wrapped_sql(source: str, key: str) -> str:
    """CTEs that wrap runs of pipe lines of ``source``(key, text)."""
    marker = fixed.TABLE_MARKER
    return f"""
  ln AS (SELECT {key}, unnest({lines_sql('text')}) AS l, generate_subscripts({lines_sql('text')}, 1) AS i FROM {source}),
  nb AS (SELECT *, contains(l, '|') AS p,
           coalesce(lag(contains(l, '|')) OVER w, false) OR coalesce(lead(contains(l, '|')) OVER w, false) AS near
         FROM ln WINDOW w AS (PARTITION BY {key} ORDER BY i)),
  isl AS (SELECT *, p AND near AS t,
            sum(CASE WHEN p AND near THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM nb),
  blk AS (SELECT {key}, min(i) AS i, t,
            CASE WHEN t THEN '{marker}' || chr(10) || string_agg(l, chr(10) ORDER BY i) || chr(10) || '{marker}'
                 ELSE any_value(l) END AS b
          FROM isl GROUP BY {key}, t, g),
  wrapped AS (SELECT {key}, string_agg(b, chr(10) ORDER BY i) AS text FROM blk GROUP BY {key})"""


# glyphs that cleaning has to undo, put into real text
_GLYPHS = {"ffi": "ﬃ", "ffl": "ﬄ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "'": "’", "-": "–"}
_WIDE = "".join(chr(0xFF10 + i) for i in range(10))


def with_glyphs(c):
    for plain, glyph in _GLYPHS.items():
        c = F.replace(c, F.lit(plain), F.lit(glyph))
    return F.translate(F.replace(c, F.lit(" de "), F.lit("\u00a0de\u200b ")), "0123456789", _WIDE)


def unicode_fix(spark, folder):
    return documents(spark, folder).select("doc_id", clean.fix_unicode(with_glyphs(F.col("text"))).alias("text"))


def ascii_fix(spark, folder):
    dirty = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\x0b")), F.lit(", "), F.lit(",\x07 "))
    return documents(spark, folder).select("doc_id", clean.fix_unicode(dirty).alias("text"))


def hyphen_join(spark, folder):
    broken = F.regexp_replace("text", "([a-z])(tion|ment)", "$1-\n$2")
    return documents(spark, folder).select("doc_id", clean.join_hyphens(broken).alias("text"))


def bullets(spark, folder):
    listed = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n  • ")), F.lit(", "), F.lit("\n»\n"))
    return documents(spark, folder).select("doc_id", clean.normalise_bullets(listed).alias("text"))


def whitespace_clean(spark, folder):
    loose = F.replace(F.replace("text", F.lit(". "), F.lit(".  \t\n\n\n \n")), F.lit(", "), F.lit(", \t  "))
    return documents(spark, folder).select("doc_id", clean.clean_whitespace(loose).alias("text"))


def marked_parts(spark, folder):
    parts = F.posexplode(clean.page_parts(F.col("text"))).alias("part_no", "part")
    return documents(spark, folder).select("doc_id", parts).select(
        "doc_id", "part_no", (F.col("part_no") % 2 == 1).alias("is_table"), "part"
    )


def header_footer_lines(spark, folder):
    return clean.header_footer_lines(pages(spark, folder))


def boilerplate_removed(spark, folder):
    raw = pages(spark, folder)
    single = raw.select("doc_name", "page", "text", F.array("text").alias("_prose"))
    unwanted = clean.unwanted_lines(single, clean.header_footer_lines(raw))
    none = F.array().cast("array<string>")
    return single.join(unwanted, ["doc_name", "page"], "left").select(
        "doc_name", "page", clean.drop_lines(F.col("text"), F.coalesce("_unwanted", none)).alias("text")
    )


def clean_pages(spark, folder):
    return clean.clean_pages(pages(spark, folder)).select("doc_name", "page", "text")


def edge_sql(text):
    return f"""list_filter(list_transform({lines_sql(text)}, lambda l: {strip_sql('l')}), lambda l: l <> '')"""


BOILERPLATE_SQL = f"""
  edges AS (SELECT doc_name, page, {edge_sql('text')} AS ls FROM pages),
  cand AS (SELECT doc_name, unnest(list_distinct(list_concat(ls[:3], ls[-3:]))) AS line FROM edges),
  boiler AS (SELECT doc_name, line, count(*) AS pages FROM cand
             WHERE length(line) > 5 AND length(line) < 200 GROUP BY ALL HAVING count(*) >= 3)"""

CLEAN_SQL = f"""{PAGES_SQL},{BOILERPLATE_SQL},
  keyed AS (SELECT doc_name || chr(31) || page AS k, text FROM pages),{wrapped_sql('keyed', 'k')},
  seg AS (SELECT k, unnest(string_split(text, '{fixed.TABLE_MARKER}')) AS s,
            generate_subscripts(string_split(text, '{fixed.TABLE_MARKER}'), 1) AS n FROM wrapped),
  bul AS (SELECT k, n, s, {bullets_sql('s')} AS b FROM seg WHERE n % 2 = 1),
  bln AS (SELECT k, n, unnest({lines_sql('b')}) AS l, generate_subscripts({lines_sql('b')}, 1) AS i FROM bul),
  kept AS (SELECT bln.* FROM bln LEFT JOIN boiler
             ON boiler.doc_name = string_split(k, chr(31))[1] AND boiler.line = {strip_sql('l')}
           WHERE boiler.line IS NULL AND NOT {NOISE_SQL}),
  prose AS (SELECT k, n, string_agg(l, chr(10) ORDER BY i) AS t FROM kept GROUP BY k, n),
  parts AS (SELECT k, n, {whitespace_sql('t')} AS t FROM prose
            UNION ALL
            SELECT k, n, CASE WHEN {strip_sql('s')} = '' THEN '' ELSE
              chr(10) || chr(10) || '[TABLE]' || chr(10) || {strip_sql('s')} || chr(10) || '[/TABLE]' END
            FROM seg WHERE n % 2 = 0),
  cleaned AS (SELECT string_split(k, chr(31))[1] AS doc_name, string_split(k, chr(31))[2]::BIGINT AS page,
                string_agg(t, chr(10) || chr(10) ORDER BY n) AS text
              FROM parts WHERE {strip_sql('t')} <> '' GROUP BY k)"""

QUERIES = {
    "unicode_fix": (unicode_fix, "SELECT doc_id, text FROM documents"),
    "control_characters": (
        ascii_fix,
        "SELECT doc_id, replace(replace(text, '. ', '. '), ', ', ', ') AS text FROM documents",
    ),
    "hyphen_join": (
        hyphen_join,
        r"SELECT doc_id, replace(regexp_replace(text, '([a-z])(tion|ment)', '\1-' || chr(10) || '\2', 'g'),"
        " '-' || chr(10), '') AS text FROM documents",
    ),
    "bullets": (
        bullets,
        "WITH d AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || chr(10) || '  • '), ', ',"
        " chr(10) || '»' || chr(10)) AS text FROM documents)"
        f" SELECT doc_id, {bullets_sql('text')} AS text FROM d",
    ),
    "noise_line_filter": (
        text_map(clean.drop_noise_lines), f"SELECT doc_id, {noise_free('text')} AS text FROM documents"
    ),
    "whitespace_clean": (
        whitespace_clean,
        "WITH d AS (SELECT doc_id, replace(replace(text, '. ', '.  ' || chr(9) || chr(10) || chr(10) || chr(10) || ' '"
        " || chr(10)), ', ', ', ' || chr(9) || '  ') AS text FROM documents)"
        f" SELECT doc_id, {whitespace_sql('text')} AS text FROM d",
    ),
    "raw_table_islands": (
        text_map(clean.wrap_raw_tables),
        f"WITH src AS (SELECT doc_id, text FROM documents),{wrapped_sql('src', 'doc_id')} SELECT doc_id, text FROM wrapped",
    ),
    "marked_parts": (
        marked_parts,
        f"""WITH src AS (SELECT doc_id, text FROM documents),{wrapped_sql('src', 'doc_id')},
        p AS (SELECT doc_id, unnest(string_split(text, '{fixed.TABLE_MARKER}')) AS part,
                (generate_subscripts(string_split(text, '{fixed.TABLE_MARKER}'), 1) - 1)::INT AS part_no FROM wrapped)
        SELECT doc_id, part_no, part_no % 2 = 1 AS is_table, part FROM p""",
    ),
    "header_footer_lines": (header_footer_lines, f"WITH {PAGES_SQL},{BOILERPLATE_SQL} SELECT * FROM boiler"),
    "boilerplate_removed_lines": (
        boilerplate_removed,
        f"""WITH {PAGES_SQL},{BOILERPLATE_SQL},
        ln AS (SELECT doc_name, page, unnest({lines_sql('text')}) AS l, generate_subscripts({lines_sql('text')}, 1) AS i FROM pages),
        kept AS (SELECT ln.* FROM ln LEFT JOIN boiler ON boiler.doc_name = ln.doc_name AND boiler.line = {strip_sql('l')}
                 WHERE boiler.line IS NULL),
        joined AS (SELECT doc_name, page, string_agg(l, chr(10) ORDER BY i) AS text FROM kept GROUP BY ALL)
        SELECT doc_name, page, coalesce(joined.text, '') AS text FROM pages LEFT JOIN joined USING (doc_name, page)""",
    ),
    "clean_pages": (clean_pages, f"WITH {CLEAN_SQL} SELECT doc_name, page, text FROM cleaned"),
    "normalise_terms": (
        text_map(normalise_terms),
        f"SELECT doc_id, {strip_sql(f'''regexp_replace(regexp_replace(lower(text), '[^{WORD_RE}{WS_RE}-]', ' ', 'g'), '[{WS_RE}]+', ' ', 'g')''')}"
        " AS text FROM documents",
    ),
    "normalise_label": (
        text_map(normalise_label),
        f"SELECT doc_id, {label_sql(chr(39).join(['replace(text, ', 'ß', ', ', 'ss', ')']))} AS text FROM documents",
    ),
}
