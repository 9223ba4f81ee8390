"""Blocks on pages that boxes cover many times over."""
import random

from docmill.operators import regions

BOX = "page long, id long, x0 double, y0 double, x1 double, y1 double"


def test_blocks_in_covered_cells_are_never_paired(spark, monkeypatch):
    paired, pairs = [], regions.overlapping

    def watched(left, *rest):
        paired.append(left.count())
        return pairs(left, *rest)

    monkeypatch.setattr(regions, "overlapping", watched)
    r = random.Random(5)
    some = lambda n, least, most: [(r.randrange(2), i, float(x := r.randrange(60)), float(y := r.randrange(60)), x + r.uniform(least, most), y + r.uniform(least, most)) for i in range(n)]
    boxes = some(9000, 3, 9) + [(0, -1, -1e6, 0.0, 1e6, 0.5), (0, -2, 900.0, 0.0, 900.5, 1e6)]
    blocks = some(1500, 0, 4) + [
        (0, 5000, 70.0, 70.0, 71.0, 71.0), (0, 5001, 5.0, 5.0, 5.0, 9.0), (None, 5002, 5.0, 5.0, 9.0, 9.0), (0, 5003, None, 5.0, 9.0, 9.0),
        (0, 5004, 5.0, 5.0, float("inf"), 9.0), (3, 5005, 5.0, 5.0, 9.0, 9.0), (0, 5006, -1e5, 0.0, -9e4, 9.0), (0, 5007, 899.0, 50.0, 902.0, 51.0),
    ]
    known = lambda t: None not in t and float("inf") not in t and t[2] < t[4] and t[3] < t[5]
    want = {x[1] for x in blocks if not any(
        known(x) and x[0] == y[0] and max(x[2], y[2]) < min(x[4], y[4]) and max(x[3], y[3]) < min(x[5], y[5]) for y in boxes
    )}
    free = regions.outside(spark.createDataFrame(blocks, BOX), spark.createDataFrame(boxes, BOX).drop("id"), ["page"], "id")
    assert {x.id for x in free.collect()} == want and len(want) >= 5
    assert paired[0] < len(blocks) / 4
