"""Chunking and duplicate queries."""
from pyspark.sql import functions as F

from docmill import fixed
from docmill.checks.category import RANKED_SQL, scores_sql
from docmill.checks.common import PAGES_SQL, collapse_sql, documents, pages, strip_sql, table
from docmill.checks.text import CLEAN_SQL
from docmill.functions.stage import computed
from docmill.functions.text import chunk_id, exact_hash, neighbour_similarity
from docmill.operators import chunk, dedup
from docmill.operators.ordering import dense_index
from docmill.plans.pipeline import build_chunks, with_display_family
from docmill.session import cut_lineage

STEP = fixed.CHUNK_SIZE - fixed.CHUNK_OVERLAP

def windows_sql(whole: str) -> str:
    """CTEs windows, long_enough and uniq of a query of (doc_name, page, seg, t)."""
    return f"""
 whole AS ({whole}),
 cut AS (SELECT doc_name, page, seg, i, {strip_sql(f'substring(t, i * {STEP} + 1, {fixed.CHUNK_SIZE})')} AS text
         FROM whole, LATERAL (SELECT unnest(range(0, greatest(ceil((length(t) - {fixed.CHUNK_SIZE}) / {STEP}), 0)::BIGINT + 1)) AS i)),
 windows AS (SELECT doc_name, page, seg, (row_number() OVER (PARTITION BY doc_name, page, seg ORDER BY i) - 1)::INT AS split, text
             FROM cut WHERE text <> ''),
 long_enough AS (SELECT * FROM windows WHERE length(text) >= {fixed.MIN_CHUNK_CHARS}),
 uniq AS MATERIALIZED (SELECT * FROM long_enough QUALIFY row_number() OVER (
            PARTITION BY doc_name, md5(lower({strip_sql('text')})) ORDER BY page, seg, split) = 1)"""


# of the pages' raw texts
WINDOWS_SQL = PAGES_SQL + "," + windows_sql(f"SELECT doc_name, page, 0 AS seg, {strip_sql('text')} AS t FROM pages")


def window_chunks(spark, folder):
    return pages(spark, folder).select(
        "doc_name", "page", F.posexplode(chunk.window_split(F.col("text"))).alias("split", "text")
    )


def raw_chunks(spark, folder):
    return chunk.prose_chunks(pages(spark, folder), "window")


def min_length_chunks(spark, folder):
    return raw_chunks(spark, folder).select("doc_name", "page", "split", F.length("text").alias("n"))


def exact_dedup(spark, folder):
    return dedup.exact_dedup(raw_chunks(spark, folder)).select("doc_name", "page", "split", exact_hash(F.col("text")).alias("hash"))


def chunk_ids(spark, folder):
    rows = dedup.exact_dedup(raw_chunks(spark, folder))
    return rows.select("doc_name", "page", "split", chunk_id(F.col("doc_name"), F.col("page"), F.col("text")).alias("chunk_id"))


def chunk_index(spark, folder):
    """Small page blocks, so that many of them follow each other."""
    rows = cut_lineage(dedup.exact_dedup(raw_chunks(spark, folder)).select("doc_name", "page", "seg", "split"))
    return dense_index(rows, ["page", "seg", "split"], "chunk_idx", block=64).select("doc_name", "page", "split", "chunk_idx")


def segments(spark, folder):
    text = F.concat("text", F.lit("\n\n[TABLE]\n"), "lang", F.lit(" | "), "source", F.lit("\n[/TABLE] \n[TABLE] ["), "lang",
                    F.lit("[/TABLE]"), "text", F.lit(" [TABLE]"))
    docs = documents(spark, folder).select(F.col("source").alias("doc_name"), F.col("doc_id").alias("page"), text.alias("text"))
    return chunk.explode_segments(docs).select("page", "seg", "is_table", "text")


SEGMENTS_SQL = f"""WITH d AS (SELECT doc_id AS page, text AS t, lang, source FROM documents),
 p AS (SELECT page, unnest([t, '[TABLE]' || chr(10) || lang || ' | ' || source || chr(10) || '[/TABLE]', '[TABLE] [' || lang || '[/TABLE]', t || ' [TABLE]']) AS s,
         unnest([1, 2, 3, 4]) AS i FROM d),
 k AS (SELECT page, i, {strip_sql('s')} AS text FROM p WHERE {strip_sql('s')} <> '')
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY i) - 1)::INT AS seg, i IN (2, 3) AS is_table, text FROM k"""


def ngram_jaccard(spark, folder):
    """Similarity of neighbouring windows of each document."""
    rows = documents(spark, folder).select("doc_id", chunk.window_split(F.col("text")).alias("w")).where(F.size("w") > 1)
    found = computed(rows, s=neighbour_similarity(F.col("w")))
    return found.select("doc_id", F.posexplode(F.transform("s", lambda x: F.round(x, 6))).alias("i", "similarity"))


_GRAMS = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))"
JACCARD_SQL = f"""WITH whole AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents),
 w AS (SELECT doc_id, i, {strip_sql(f'substring(t, i * {STEP} + 1, {fixed.CHUNK_SIZE})')} AS c
       FROM whole, LATERAL (SELECT unnest(range(0, greatest(ceil((length(t) - {fixed.CHUNK_SIZE}) / {STEP}), 0)::BIGINT + 1)) AS i)),
 n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, {collapse_sql('lower(c)')} AS s FROM w WHERE c <> ''),
 g AS (SELECT doc_id, i, CASE WHEN length(s) >= 3 THEN {_GRAMS} ELSE [] END AS g FROM n),
 pr AS (SELECT a.doc_id, a.i, len(list_intersect(a.g, b.g)) AS shared, len(a.g) AS na, len(b.g) AS nb
        FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i = a.i + 1)
SELECT doc_id, i::INT AS i, CASE WHEN na = 0 AND nb = 0 THEN 1 ELSE round(shared / (na + nb - shared), 6) END::DOUBLE AS similarity FROM pr"""


def near_dedup(spark, folder):
    """A source spans several page blocks, so starting windows travel."""
    rows = dedup.exact_dedup(raw_chunks(spark, folder))
    return dedup.near_dedup(rows).select("doc_name", "page", "split")


DRIFT_BLOCK = 64


def near_dedup_drift(spark, folder):
    """Customers as chunks of one file, each of fifty words and a word further than
    the one before: which are kept depends on the first one, all the way."""
    words = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.left(F.md5((F.col("c_custkey") + j).cast("string")), F.lit(6)))
    rows = table(spark, folder, "customer").select(
        F.lit("drift.pdf").alias("doc_name"), (F.col("c_custkey") * 1000000).alias("page"), F.lit(0).alias("seg"), F.lit(0).alias("split"), F.array_join(words, " ").alias("text")
    )
    return dedup.near_dedup(rows, block=DRIFT_BLOCK).select("doc_name", "page")


# the sequential rule as a recursion over ``uniq``: one chunk per file and step
KEPT_SQL = f"""
 seq AS MATERIALIZED (SELECT doc_name, page, seg, split, row_number() OVER (PARTITION BY doc_name ORDER BY page, seg, split) AS n,
          list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) AS g
        FROM (SELECT *, {collapse_sql(f'lower({strip_sql("text")})')} AS s FROM uniq)),
 grams AS (SELECT doc_name, n, len(g) AS z, unnest(g) AS w FROM seq),
 freq AS (SELECT w, count(*) AS f FROM grams GROUP BY w),
 -- sets with Jaccard 0.92 share one of their rarest grams
 rare AS (SELECT doc_name, n, z, w FROM (SELECT grams.*, row_number() OVER (PARTITION BY doc_name, n ORDER BY f, w) AS r FROM grams JOIN freq USING (w))
          WHERE r <= z - ceil(0.92 * z) + 1),
 close AS (SELECT DISTINCT a.doc_name, b.n AS n, a.n AS m FROM rare a JOIN rare b ON a.doc_name = b.doc_name AND a.w = b.w AND a.n < b.n
          WHERE a.z >= 0.92 * b.z AND b.z >= 0.92 * a.z),
 pairs AS MATERIALIZED (SELECT c.doc_name, c.n, c.m FROM close c JOIN grams a ON a.doc_name = c.doc_name AND a.n = c.m
           JOIN grams b ON b.doc_name = c.doc_name AND b.n = c.n AND b.w = a.w
         GROUP BY c.doc_name, c.n, c.m, a.z, b.z HAVING count(*) / (a.z + b.z - count(*)) >= 0.92),
 near AS MATERIALIZED (SELECT seq.doc_name, seq.n, coalesce(list(m) FILTER (m IS NOT NULL), []) AS ms
          FROM seq LEFT JOIN pairs USING (doc_name, n) GROUP BY ALL),
 walk AS (SELECT doc_name, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS keep FROM (SELECT DISTINCT doc_name FROM seq)
   UNION ALL
   SELECT w.doc_name, x.n, CASE WHEN len(list_intersect(w.kept, x.ms)) = 0 THEN list_append(w.kept, x.n)[-{fixed.DEDUP_WINDOW}:] ELSE w.kept END,
     len(list_intersect(w.kept, x.ms)) = 0
   FROM walk w JOIN near x ON x.doc_name = w.doc_name AND x.n = w.n + 1),
 kept AS (SELECT doc_name, page, seg, split FROM walk JOIN seq USING (doc_name, n) WHERE keep)"""

NEAR_SQL = f"WITH RECURSIVE {WINDOWS_SQL},{KEPT_SQL} SELECT doc_name, page, split FROM kept"

DRIFT_SQL = f"""WITH RECURSIVE uniq AS (SELECT 'drift.pdf' AS doc_name, c_custkey * 1000000 AS page, 0 AS seg, 0 AS split,
   array_to_string(list_transform(range(0, 50), lambda j: substr(md5((c_custkey + j)::VARCHAR), 1, 6)), ' ') AS text FROM customer),{KEPT_SQL}
SELECT doc_name, page FROM kept"""


def base_meta(spark, folder):
    """Family columns fill each other; missing ones become empty."""
    part = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("doc_name"), F.col("p_brand").alias("vendor"), F.lit("C").alias("category"),
        F.nullif("p_type", F.lit("SMALL")).alias("family"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("product_family"),
        F.when(F.col("p_size") < 5, F.col("p_brand")).alias("display_family"),
    )
    return chunk.with_base_meta(part)


BASE_SQL = """WITH p AS (SELECT p_partkey::VARCHAR AS doc_name, p_brand AS vendor, 'C' AS category, nullif(p_type, 'SMALL') AS f,
   CASE WHEN p_size > 25 THEN p_name END AS pf, CASE WHEN p_size < 5 THEN p_brand END AS df FROM part)
SELECT doc_name, vendor, category, coalesce(f, pf, '') AS family, coalesce(pf, f, '') AS product_family,
  coalesce(df, f, pf, '') AS display_family FROM p"""


def display_family(spark, folder):
    c = table(spark, folder, "customer")
    models = F.when(F.col("c_acctbal") > 0, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    meta = c.select(
        F.col("c_custkey").alias("doc_name"), models.alias("models"), F.col("c_mktsegment").alias("category"),
        F.col("c_name").alias("product_family"),
    )
    return with_display_family(meta).select("doc_name", "display_family")


def recursive_chunks(spark, folder):
    return chunk.prose_chunks(pages(spark, folder)).select("doc_name", "page", "split", "text")


def corpus_chunks(spark, folder):
    """Raw pages to numbered chunks: cleaning, metadata, categories, dedup, tables."""
    chunks = build_chunks(pages(spark, folder), "window")[0]
    return chunks.select("doc_name", "page", "chunk_idx", "chunk_type", "chunk_id", "has_table", "category", "vendor")


_BLOCK_RE = r"'(?s)\[TABLE\].*?\[/TABLE\]'"
CORPUS_SQL = f"""WITH RECURSIVE {CLEAN_SQL.replace('kept', 'clean_lines')},
 pr AS (SELECT doc_name, page, unnest(string_split_regex(text, {_BLOCK_RE})) AS s, generate_subscripts(string_split_regex(text, {_BLOCK_RE}), 1) * 2 AS seg FROM cleaned),
 tb AS (SELECT doc_name, page, unnest(regexp_extract_all(text, {_BLOCK_RE})) AS s, generate_subscripts(regexp_extract_all(text, {_BLOCK_RE}), 1) * 2 + 1 AS seg FROM cleaned),
 {windows_sql(f"SELECT doc_name, page, seg, {strip_sql('s')} AS t FROM pr WHERE {strip_sql('s')} <> ''").lstrip()},{KEPT_SQL},
 a AS (SELECT doc_name, page, seg, split, text, 0 AS phase FROM kept JOIN uniq USING (doc_name, page, seg, split) UNION ALL
       SELECT doc_name, page, seg, 0, {strip_sql('s')}, 1 FROM tb),
 {scores_sql("SELECT doc_name, string_agg(text, chr(10) ORDER BY page) AS text FROM cleaned GROUP BY doc_name")}, {RANKED_SQL}
SELECT a.doc_name, page, row_number() OVER (PARTITION BY a.doc_name ORDER BY phase, page, seg, split) - 1 AS chunk_idx,
  CASE WHEN phase = 1 THEN 'table_full' ELSE 'semantic' END AS chunk_type, md5(a.doc_name || '|' || page || '|' || text) AS chunk_id,
  phase = 1 AS has_table, CASE WHEN score > 0 THEN category ELSE 'GENERAL' END AS category,
  upper(a.doc_name[1]) || string_split(a.doc_name, '.')[1][2:] AS vendor
FROM a JOIN ranked ON ranked.doc_name = a.doc_name AND r = 1"""


QUERIES = {
    "corpus_chunks": (corpus_chunks, CORPUS_SQL),
    "window_chunks": (window_chunks, f"WITH {WINDOWS_SQL} SELECT doc_name, page, split, text FROM windows"),
    "min_length_chunks": (
        min_length_chunks, f"WITH {WINDOWS_SQL} SELECT doc_name, page, split, length(text)::INT AS n FROM long_enough"
    ),
    "exact_dedup": (
        exact_dedup, f"WITH {WINDOWS_SQL} SELECT doc_name, page, split, md5(lower({strip_sql('text')})) AS hash FROM uniq"
    ),
    "chunk_ids": (
        chunk_ids, f"WITH {WINDOWS_SQL} SELECT doc_name, page, split, md5(doc_name || '|' || page || '|' || text) AS chunk_id FROM uniq"
    ),
    "chunk_index": (
        chunk_index,
        f"WITH {WINDOWS_SQL} SELECT doc_name, page, split,"
        " row_number() OVER (PARTITION BY doc_name ORDER BY page, split) - 1 AS chunk_idx FROM uniq",
    ),
    "segments": (segments, SEGMENTS_SQL),
    "ngram_jaccard": (ngram_jaccard, JACCARD_SQL),
    "near_dedup": (near_dedup, NEAR_SQL),
    "near_dedup_drift": (near_dedup_drift, DRIFT_SQL),
    "base_meta": (base_meta, BASE_SQL),
    "display_family": (
        display_family,
        "SELECT c_custkey AS doc_name, CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment END AS display_family FROM customer",
    ),
    "recursive_chunks": (recursive_chunks, None),
}
