"""Column names that a table doesn't have yet."""
from pyspark.sql import DataFrame


def fresh(table: DataFrame | list[str], *wanted: str) -> list[str]:
    """For each wanted name, itself or the name with underscores before it:
    different, without regard to case, from all columns and from one another."""
    taken = {c.lower() for c in (table if isinstance(table, list) else table.columns)}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
