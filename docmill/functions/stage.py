"""A barrier between expensive column expressions."""
from pyspark.sql import DataFrame, functions as F


def computed(df: DataFrame, **columns) -> DataFrame:
    """Like ``withColumns``, but each expression is evaluated exactly once.

    Catalyst copies a projected expression into every filter on it that it
    pushes down, and into the size check it infers for an ``explode``. It cannot
    look through a generator, so a one-element ``explode`` holds the value.
    """
    for name, expression in columns.items():
        rest = [c for c in df.columns if c != name]
        df = df.select(*rest, F.explode(F.array(expression)).alias("_new"), *([name] if name in df.columns else []))
        df = df.select(*rest, F.col("_new").alias(name))
    return df
