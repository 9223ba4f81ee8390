"""Dense row numbers over a whole table, without a task that sees all of it."""
from pyspark.sql import Column, DataFrame, functions as F

from docmill.session import cut_lineage


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the long column ``name``: 0, 1, ... in ``order``, or in any order
    if none is given. A column so named is replaced; an empty table stays empty.

    Two passes: the rows are sorted over the cluster and stored with their place in
    their partition, then the partitions' sizes (a row for each of them, however
    large the table) are added up and joined back as offsets. Ties in ``order`` are
    numbered in an arbitrary but stored, hence stable, order.
    """
    at, part, start = _apart(df.columns, "at", "part", "start")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]) if not order else df
    if order:
        rows = rows.orderBy(*order)
        rows = rows.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])
    held = cut_lineage(rows.withColumn(at, F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for row in sorted(sizes):
        starts.append((row[0], total))
        total += row[1]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} long, {start} long")
    place = F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(offsets), part)
        .withColumn(name, place).drop(at, part, start)
    )


def _apart(columns: list[str], *names: str) -> list[str]:
    """Names that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        n = "_" + n
        while n in taken:
            n = "_" + n
        out.append(n)
    return out
