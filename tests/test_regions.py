"""Overlapping rectangles against all pairs, and a page of very many."""
import random

from docmill.operators import regions

BOX = "page long, id long, x0 double, y0 double, x1 double, y1 double"


def rectangles(r, n, pages):
    out = []
    for i in range(n):
        x, y, side = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.01, 0.5, 3, 40])
        out.append((r.randrange(pages), i, x, y, x + r.uniform(0, side), y + r.uniform(0, side)))
    return out


def test_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    a = rectangles(r, 250, 3) + [(0, 900, 1.0, 1.0, 1.0, 9.0), (0, 901, 5.0, 5.0, 4.0, 9.0), (1, 902, None, 0.0, 1.0, 1.0), (1, 903, 0.0, 0.0, float("inf"), 1.0), (None, 904, 0.0, 0.0, 1.0, 1.0)]
    b = rectangles(r, 200, 3) + [(0, 950, -1e6, -1e6, 1e6, 1e6), (2, 951, 0.0, 0.0, 8.0, 8.0), (2, 952, 8.0, 0.0, 16.0, 8.0)]
    a += [(2, 905, 4.0, 4.0, 8.0, 8.0)]
    known = lambda t: None not in t and float("inf") not in t and t[2] < t[4] and t[3] < t[5]
    want = {
        (x[1], y[1]) for x in a for y in b if known(x) and known(y) and x[0] == y[0]
        and max(x[2], y[2]) < min(x[4], y[4]) and max(x[3], y[3]) < min(x[5], y[5])
    }
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX).withColumnRenamed("id", "other")
    got = [tuple(x) for x in regions.overlapping(left, right, ["page"], "id", "other").collect()]
    assert sorted(got) == sorted(want) and len(want) > 200
    free = {x.id for x in regions.outside(left, right, ["page"], "id").collect()}
    assert free == {x[1] for x in a} - {i for i, _ in want}
    assert regions.outside(left, right.limit(0), ["page"], "id").count() == len(a)
    assert regions.outside(left.limit(0), right, ["page"], "id").count() == 0


def test_a_page_of_many_boxes(spark):
    """Work follows the rectangles near one another, not the page's pairs."""
    n = 100_000
    boxes = spark.range(n).selectExpr("1L AS page", "id % 400 * 10.0 AS x0", "id div 400 * 10.0 AS y0", "id % 400 * 10.0 + 4 AS x1", "id div 400 * 10.0 + 4 AS y1")
    blocks = spark.range(n).selectExpr("1L AS page", "id", "id % 400 * 10.0 + if(id % 2 = 0, 2, 5) AS x0", "id div 400 * 10.0 + 1 AS y0", "id % 400 * 10.0 + 7 AS x1", "id div 400 * 10.0 + 3 AS y1")
    free = regions.outside(blocks, boxes, ["page"], "id")
    assert free.count() == n // 2 and free.where("id % 2 = 0").count() == 0
