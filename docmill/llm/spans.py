"""Substring dedup over sliding sentence spans.

Every run of ``run`` consecutive sentences is hashed (128 bits), the hashes are
grouped over all documents, and a sentence goes if any repeated span other than
the first one covers it. The first is the one of the smallest document id, then
text hash, then position.

A sentence ends after full stops, exclamation or question marks or line feeds,
with the white space behind them; the sentences of a text put together are the
text. Spans under ``least`` characters (without outer white space) don't count:
very short sentences meet by chance. The spans are grouped with partial
aggregation, and met again by a plain join whose large side Spark can split, so
a span that a third of the corpus holds is no hot task.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill.llm.names import fresh

SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"


def _sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def _spans(docs: DataFrame, run: int, least: int) -> DataFrame:
    """``doc``, ``t`` (text hash), ``at`` (first sentence from 0), ``a`` and ``b`` (hash) of every span."""
    trimmed = F.transform(_sentences(F.col("text")), lambda s: F.trim(s, F.lit(" \t\r\n")))
    # a generator holds the sentences, so that they are found once
    listed = docs.where("text IS NOT NULL").select("doc", F.xxhash64("text").alias("t"), F.explode(F.array(trimmed)).alias("s"))

    def one(i: Column) -> Column:
        parts = [F.get("s", i + F.lit(k)) for k in range(run)]
        size = sum((F.length(p) for p in parts[1:]), F.length(parts[0]))
        return F.when(size >= least, F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")))

    runs = F.transform(F.sequence(F.lit(0), F.size("s") - run), one)
    return (
        listed.where(F.size("s") >= run).select("doc", "t", F.posexplode(runs).alias("at", "h"))
        .where("h IS NOT NULL").select("doc", "t", "at", "h.a", "h.b")
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 2, least: int = 40,
                    removed: str = "n_removed", total: str = "n_sentences") -> DataFrame:
    """``docs`` without the sentences that repeated spans cover, with the number
    of sentences before and of those removed (in place of columns so named).

    All rows stay; a null text stays null, with no sentences. Rows equal in key
    and text are one document here and treated alike.
    """
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    spans = _spans(own, run, least)
    place = F.struct("doc", "t", "at")
    first = (
        spans.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).select("a", "b", "first")
    )
    covered = (
        spans.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc", "t").agg(F.collect_set("at").alias("_ats"))  # at most the text's own sentences
    )
    _t, _doc, _of, _ats, _gone, _all = fresh(docs, "t", "doc", "of", "ats", "gone", "all")
    rest = [c for c in docs.columns if c.lower() not in (removed.lower(), total.lower())]
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(F.col(f"`{text}`")).alias(_t)).join(
        covered.toDF(_doc, _of, _ats), F.col(f"`{key}`").eqNullSafe(F.col(_doc)) & (F.col(_t) == F.col(_of)), "left"
    )
    gone = F.array_distinct(F.flatten(F.transform(_ats, lambda i: F.sequence(i, i + F.lit(run - 1)))))
    sentences = F.coalesce(_sentences(F.col(f"`{text}`")), F.array())
    joined = joined.withColumn(_gone, gone).withColumn(_all, F.size(sentences).cast("long"))
    kept = F.array_join(F.filter(sentences, lambda s, i: ~F.array_contains(_gone, i)), "")
    new = F.when(F.col(_gone).isNull(), F.col(f"`{text}`")).otherwise(kept)
    return joined.select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in rest],
        F.col(_all).alias(total), F.coalesce(F.size(_gone), F.lit(0)).cast("long").alias(removed),
    )
