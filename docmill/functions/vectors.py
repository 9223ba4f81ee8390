"""Column functions over embedding arrays."""
from pyspark.sql import Column, functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    from docmill.functions.text import let

    return let(
        F.struct(a.alias("v"), norm(a).alias("n")),
        lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0))),
    )


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
