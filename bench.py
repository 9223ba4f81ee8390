"""Time the headline queries and print one JSON line."""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docmill.checks.registry import QUERIES, flagship  # noqa: E402
from docmill.session import local_session  # noqa: E402

HEADLINES = [
    "clean_pages", "header_footer_lines", "raw_table_islands", "unicode_fix", "category_best", "category_scores",
    "model_codes", "vendor_best", "window_chunks", "recursive_chunks", "exact_dedup", "near_dedup", "chunk_index",
    "ngram_jaccard", "markdown_parse", "spec_column_tables", "spec_grouped_headers", "corpus_chunks",
    "upsert_latest", "kb_stats", "topk_cosine", "text_retrieval",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "docmill-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
    })
    flagship(spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM and the workers
    seconds = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        QUERIES[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
