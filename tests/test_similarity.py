"""Similarity of neighbouring texts."""
from pyspark.sql import functions as F

from docmill.functions.stage import computed
from docmill.functions.text import neighbour_similarity


def test_neighbour_similarity(spark):
    def grams(text):
        flat = " ".join(text.lower().split())
        return {flat[i : i + 3] for i in range(len(flat) - 2)}

    texts = ["Abc  def", "abc DEF", "xyz", "x", "", "ab", "😀😀😀 á ß", "😀😀😀 b", " b 😀😀😀 "]
    want = []
    for x, y in zip(map(grams, texts), map(grams, texts[1:])):
        want.append(1.0 if not x | y else len(x & y) / len(x | y))
    rows = spark.createDataFrame([(1, texts), (2, ["one"]), (3, None)], "id int, w array<string>")
    found = computed(rows, s=neighbour_similarity(F.col("w")))
    assert {r.id: r.s for r in found.collect()} == {1: want, 2: [], 3: None}
    assert want[0] == 1.0 and want[3] == 1.0 and 0 < want[6] < 1
