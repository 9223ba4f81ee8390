"""Registered queries of the operators and their SQL."""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import audit, decontaminate, lines, minhash, neighbours, phrases, pieces, pii, quality, secret_spans, sharding, spans, tokenfiles
from docmill.session import checkpoint_folder

SHARDS, SLOTS = 48, 5003
#: Labels whose key falls into this remainder are held out.
FOLDS = 5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark, folder):
    """Slot and shard of every document, by its id."""
    table = sharding.lookup_table(sharding.named_shards(spark, SHARDS), SLOTS)
    placed = sharding.place(_table(spark, folder, "documents"), F.col("doc_id"), table, SLOTS)
    return placed.select("doc_id", "slot", "shard")


OP1_SQL = f"""
WITH RECURSIVE names AS (
  SELECT 'shard-' || i AS shard, row_number() OVER (ORDER BY 'shard-' || i) - 1 AS turn FROM range({SHARDS}) t(i)
), who AS (
  SELECT shard, turn, ('0x' || substr(md5(shard), 1, 12))::BIGINT % {SLOTS} AS off,
    ('0x' || substr(md5(shard), 13, 12))::BIGINT % {SLOTS - 1} + 1 AS stride FROM names
), claims(turn, free, slot, shard) AS (
  SELECT 0::BIGINT, range({SLOTS}), NULL::BIGINT, NULL::VARCHAR
  UNION ALL
  SELECT turn + 1, list_filter(free, lambda x: x <> best), best, shard FROM (
    SELECT c.turn, c.free, w.shard,
      list_min(list_transform(c.free, lambda x: ((x - w.off + {SLOTS}) * w.stride % {SLOTS}) * {SLOTS} + x)) % {SLOTS} AS best
    FROM claims c JOIN who w ON w.turn = c.turn % {SHARDS} WHERE c.turn < {SLOTS})
), keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
)
SELECT k.doc_id, k.slot, c.shard FROM keyed k LEFT JOIN claims c ON c.slot = k.slot
"""


def op2_neighbours(spark, folder):
    """The 20 nearest vectors found of every twentieth vector."""
    vectors = _table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


def op3_decontamination(spark, folder):
    """Hit words and benchmark items of every document."""
    found = decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS gram
  FROM b WHERE len(words) > 0
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM w, sizes WHERE len(words) >= n
), found AS (
  SELECT a.doc, a.n, a.i, g.item_id FROM (SELECT doc, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM places) a JOIN grams g ON g.gram = a.gram AND g.n = a.n
), hit AS (
  SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc, n, i FROM found)) GROUP BY doc
), items AS (
  SELECT doc, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc) LEFT JOIN items USING (doc)
"""


def op4_token_files(spark, folder):
    """Ids of every document, written to files and read back; ``by_key`` tells
    whether the index finds the document under its id."""
    import public_tokenizers

    store = f"{checkpoint_folder(spark)}/docmill-ids-{uuid.uuid4().hex}"
    tokenfiles.write(_table(spark, folder, "documents"), store, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    stored = tokenfiles.TokenStore(spark, store)
    there = (F.col("first") <= F.col("ordinal")) & (F.col("ordinal") < F.col("first") + F.col("copies"))
    return stored.found(stored.documents()).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.col("crc32").alias("ids_crc32"), there.alias("by_key")
    )


def _joined(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_personal_data(spark, folder):
    """Personal data of every document: numbers and hash of plain spans, all spans."""
    found = pii.personal_data(_table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(F.encode(_joined("base"), "UTF-8"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )


def op6_span_dedup(spark, folder):
    """Documents without sentences that repeat in runs."""
    return spans.without_repeats(_table(spark, folder, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


OP6_SQL = r"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+')) AS part, generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+'), 1) AS i
  FROM (SELECT DISTINCT doc_id, text FROM d WHERE text IS NOT NULL)),
w AS (SELECT *, trim(part, chr(32) || chr(9) || chr(13) || chr(10)) AS x, lead(trim(part, chr(32) || chr(9) || chr(13) || chr(10))) OVER (PARTITION BY doc_id, text ORDER BY i) AS y FROM s),
p AS (SELECT doc_id, text, i, count(*) OVER (PARTITION BY x, y) AS n,
    row_number() OVER (PARTITION BY x, y ORDER BY doc_id NULLS FIRST, i) AS k FROM w WHERE y IS NOT NULL AND length(x) + length(y) >= 40),
c AS (SELECT DISTINCT doc_id, text, unnest([i, i + 1]) AS i FROM p WHERE n > 1 AND k > 1),
m AS (SELECT s.doc_id, s.text, count(*) AS n, count(c.i) AS gone, coalesce(string_agg(s.part, '' ORDER BY s.i) FILTER (c.i IS NULL), '') AS kept
  FROM s LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM s.doc_id AND c.text = s.text AND c.i = s.i GROUP BY s.doc_id, s.text)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_sentences, coalesce(m.gone, 0)::BIGINT AS n_removed, CASE WHEN coalesce(m.gone, 0) = 0 THEN d.text ELSE m.kept END AS text
FROM d LEFT JOIN m ON m.doc_id IS NOT DISTINCT FROM d.doc_id AND m.text = d.text
"""


def op7_line_dedup(spark, folder):
    """Documents without the boilerplate lines of their source."""
    docs = _table(spark, folder, "documents")
    clean = lines.without_boilerplate(docs, F.col("source"), dropped="n_dropped")
    return clean.select("doc_id", "source", "n_dropped", "text")


OP7_SQL = """
WITH d AS (SELECT *, row_number() OVER () AS r, coalesce(source, '') AS host FROM documents),
p AS (SELECT DISTINCT host, text FROM d WHERE text IS NOT NULL),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT host, line, count(*) AS pages FROM (
    SELECT DISTINCT host, text, trim(x) AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS x FROM p) WHERE trim(x) <> '')
  GROUP BY host, line),
bad AS (SELECT host, line FROM l JOIN t USING (host) WHERE pages >= 5 AND pages >= 0.02::DOUBLE * total),
s AS (SELECT r, host, i, string_split(text, chr(10))[i] AS x FROM (SELECT r, host, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
m AS (SELECT r, count(*) FILTER (bad.line IS NOT NULL) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (bad.line IS NULL), '') AS kept
  FROM s LEFT JOIN bad ON bad.host = s.host AND bad.line = trim(s.x) GROUP BY r)
SELECT doc_id, source, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN coalesce(n_dropped, 0) = 0 THEN text ELSE kept END AS text
FROM d LEFT JOIN m USING (r)
"""


def piece_model() -> pieces.Pieces:
    import public_tokenizers

    return pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def op8_pieces(spark, folder):
    """Ids of every document, and whether decoding them gives its text again."""
    back = pieces.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), piece_model())
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


def op9_near_duplicates(spark, folder):
    """Component of every document, and whether it is its component's first."""
    found = minhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    )


def held_out(key):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Classifier:
    return quality.train(docs, labels.where(~held_out(F.col("doc_id"))))


def op10_quality(spark, folder):
    """Probability of good quality of every document."""
    docs = _table(spark, folder, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality_model(docs, _table(spark, folder, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_phrases(spark, folder):
    """The collocations of every language."""
    return phrases.collocations(_table(spark, folder, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT c.lang, c.phrase, c.a, n.n, x.f AS l, y.f AS r, cut, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN n ON n.lang = c.lang
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, c.a FROM c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < c.k AND i + m - 1 <= c.k
), kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def op12_filter_audit(spark, folder):
    """What five filters remove, alone and in all 120 orders."""
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT doc_id, part, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w
), c AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), x AS (SELECT * FROM range(1, 6) t(i)),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, array_to_string(list_transform([a.i, b.i, c.i, d.i, e.i], lambda i: chr((64 + i)::INT)), '') AS filter_order
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (SELECT o, filter_order, i AS step, o[i] AS filter FROM o, x),
t AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails, fails[filter] AS own, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS before FROM c, s
), g AS (
  SELECT part, filter_order, step, filter,
    sum(n) FILTER (NOT before AND NOT own) AS kept, sum(n) FILTER (NOT before AND own) AS removed, sum(n) FILTER (before AND own) AS redundant,
    sum(n) FILTER (own AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
    sum(good) FILTER (NOT before AND own) AS good_lost, sum(toxic) FILTER (NOT before AND own) AS toxic_lost
  FROM t GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step::INT AS step, chr((64 + filter)::INT) AS filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM g
"""


def op13_secrets(spark, folder):
    """Secrets of every document: numbers and hash of plain spans, all spans."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = secret_spans.secrets(docs, secret_spans.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, ("assign", "access", "hex")),
        F.sha2(F.encode(_joined("base"), "UTF-8"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )


QUERIES = {
    "op1_sharding": (op1_sharding, OP1_SQL),
    "op2_neighbours": (op2_neighbours, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_token_files": (op4_token_files, None),
    "op5_personal_data": (op5_personal_data, None),
    "op6_span_dedup": (op6_span_dedup, OP6_SQL),
    "op7_line_dedup": (op7_line_dedup, OP7_SQL),
    "op8_pieces": (op8_pieces, None),
    "op9_near_duplicates": (op9_near_duplicates, None),
    "op10_quality": (op10_quality, None),
    "op11_phrases": (op11_phrases, OP11_SQL),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_secrets": (op13_secrets, None),
}
