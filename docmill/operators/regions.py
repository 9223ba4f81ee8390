"""Rectangles that overlap, by grid cells and equi-joins.

Every rectangle has a level, the power of two that its longer side fits into, and
lies in at most four cells of that size. Two rectangles that overlap share a cell of
the coarser of their levels. So each is listed in its own cells, and in the cells of
the coarser levels that the other side has; pairs meet by page, level and cell where
at least one of them is at home. A page with any number of rectangles falls into many
keys, and a small rectangle never meets those that are far away. Of the cells that a
pair shares, the one of its common lower corner owns it, so each pair comes once.

Whether a block lies outside all boxes needs no pairs where boxes lie densely: a cell
inside a box decides all blocks that begin in it. Only the others are paired with boxes.

Coordinates of a rectangle: ``x0``, ``y0``, ``x1``, ``y1``. One with a null, or without
an area, overlaps nothing; touching edges don't count.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill.session import cut_lineage

SIDES = ("x0", "y0", "x1", "y1")
LEAST_LEVEL, MOST_LEVEL = -30, 60
#: Cells of a box, along a side, that are listed as covered; coordinates, in cells, up to which floors are exact.
MOST_COVERED, EXACT = 32, 2.0**50
_AREA = "{0}x0 < {0}x1 AND {0}y0 < {0}y1 AND {0}x1 < double('infinity') AND {0}x0 > double('-infinity') AND {0}y1 < double('infinity') AND {0}y0 > double('-infinity')"


def overlap(a: str, b: str) -> Column:
    """Rectangles of two tables share an area."""
    return (
        (F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")) < F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")))
        & (F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0")) < F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")))
    )


def _at(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _placed(rows: DataFrame, page: list[str], box: Column, rest: list[Column]) -> DataFrame:
    """``_box`` and ``_level`` of the rectangles that have an area."""
    side = F.greatest(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    level = F.greatest(F.least(F.ceil(F.log2(side)), F.lit(MOST_LEVEL)), F.lit(LEAST_LEVEL)).cast("int")
    return (
        rows.select(*page, *rest, box.alias("_box"))
        .where(_AREA.format("_box."))
        .withColumn("_level", level)
    )


def _listed(placed: DataFrame, other: DataFrame, page: list[str]) -> DataFrame:
    """A row per cell: own ones, and those of the coarser levels of the other side,
    of which there are at most ``MOST_LEVEL - LEAST_LEVEL`` over all pages."""
    levels = other.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    coarser = F.filter("_levels", lambda l: l > F.col("_level"))
    cells = F.flatten(F.transform(F.concat(F.array("_level"), coarser), lambda l: F.flatten(F.transform(
        F.sequence(_at(F.col("_box.x0"), l), _at(F.col("_box.x1"), l)),
        lambda x: F.transform(F.sequence(_at(F.col("_box.y0"), l), _at(F.col("_box.y1"), l)), lambda y: F.struct(l.alias("level"), x.alias("x"), y.alias("y"))),
    ))))
    # one row of at most 91 numbers
    return placed.crossJoin(F.broadcast(levels)).select("*", F.explode(cells).alias("_cell")).drop("_levels")


def _box(rows: DataFrame) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(c) for c in SIDES])


def overlapping(left: DataFrame, right: DataFrame, page: list[str], left_id: str, right_id: str) -> DataFrame:
    """``left_id``, ``right_id`` of the rectangles of one page that overlap, each pair once."""
    a = _placed(left, page, _box(left), [F.col(left_id).alias("_a")])
    b = _placed(right, page, _box(right), [F.col(right_id).alias("_b")])
    rows_a = _listed(a, b, page).withColumnsRenamed({"_box": "_box_a", "_level": "_level_a"})
    rows_b = _listed(b, a, page).withColumnsRenamed({"_box": "_box_b", "_level": "_level_b"})
    met = rows_a.join(rows_b, [*page, "_cell"]).where(
        (F.greatest("_level_a", "_level_b") == F.col("_cell.level")) & overlap("_box_a", "_box_b")
    )
    corner = lambda c: _at(F.greatest(F.col(f"_box_a.{c}0"), F.col(f"_box_b.{c}0")), F.col("_cell.level"))
    owner = (F.col("_cell.x") == corner("x")) & (F.col("_cell.y") == corner("y"))
    return met.where(owner).select(F.col("_a").alias(left_id), F.col("_b").alias(right_id))


def _usual_level(placed: DataFrame) -> DataFrame:
    """One row ``_fine``: the largest cells that half of the boxes are as wide and as high as."""
    side = F.least(F.col("_box.x1") - F.col("_box.x0"), F.col("_box.y1") - F.col("_box.y0"))
    level = F.greatest(F.least(F.floor(F.log2(side)), F.lit(MOST_LEVEL)), F.lit(LEAST_LEVEL))
    return placed.agg(F.percentile_approx(level, 0.5).cast("int").alias("_fine"))


def _within_exact(box: str) -> Column:
    size = F.greatest(*[F.abs(F.col(f"{box}{c}").cast("double")) for c in SIDES])
    return size / F.pow(F.lit(2.0), F.col("_fine")) < EXACT


def _covered(placed: DataFrame, level: DataFrame, page: list[str]) -> DataFrame:
    """(page, _x, _y): cells inside a box. Not all of them, of a box far larger than the cells."""
    cells = F.pow(F.lit(2.0), F.col("_fine"))
    first = {c: F.ceil(F.col(f"_box.{c}0") / cells).cast("long") for c in "xy"}
    last = {c: (F.floor(F.col(f"_box.{c}1") / cells) - 1).cast("long") for c in "xy"}
    whole = placed.crossJoin(F.broadcast(level)).where(_within_exact("_box."))
    whole = whole.select(*page, *[e.alias(f"_{n}{c}") for n, side in (("from", first), ("to", last)) for c, e in side.items()])
    whole = whole.where("_fromx <= _tox AND _fromy <= _toy")
    run = lambda c: F.explode(F.sequence(f"_from{c}", F.least(F.col(f"_to{c}"), F.col(f"_from{c}") + MOST_COVERED - 1))).alias(f"_{c}")
    return whole.select(*page, "_fromy", "_toy", run("x")).select(*page, "_x", run("y")).distinct()


def outside(blocks: DataFrame, boxes: DataFrame, page: list[str], block_id: str) -> DataFrame:
    """Blocks that overlap no box of their page. ``block_id`` is unique and never null.

    A block whose first cell a box covers is hit. The rest is stored and paired; a block
    that many boxes cover counts once per task before it is joined back."""
    boxes = boxes.select(*page, *SIDES, F.lit(1).alias("_one"))
    placed = _placed(boxes, page, _box(boxes), [])
    level = cut_lineage(_usual_level(placed))
    corner = lambda c: F.when(
        F.expr(_AREA.format("")) & _within_exact(""), F.floor(F.col(f"{c}0").cast("double") / F.pow(F.lit(2.0), F.col("_fine"))).cast("long")
    ).alias(f"_{c}")
    begun = blocks.crossJoin(F.broadcast(level)).select(*[F.col(f"`{c}`") for c in blocks.columns], corner("x"), corner("y"))
    rest = cut_lineage(begun.join(_covered(placed, level, page), [*page, "_x", "_y"], "left_anti").select(*[F.col(f"`{c}`") for c in blocks.columns]))
    hit = overlapping(rest, boxes, page, block_id, "_one").select(block_id).distinct()
    return rest.join(hit, block_id, "left_anti")
