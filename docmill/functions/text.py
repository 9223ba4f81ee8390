"""Column functions over strings."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from docmill import fixed


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst may inline a projected column into a later lambda, where it would
    run once per element; a bound lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim the full Unicode white space set at both ends."""
    return F.btrim(c, F.lit(fixed.WS_CHARS))


def lines(c) -> Column:
    return F.split(c, "\n", -1)


def collapse_ws(c) -> Column:
    return F.regexp_replace(c, f"[{fixed.WS}]+", " ")


def normalise_label(c) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def normalise_terms(c) -> Column:
    """Lower-case words joined by single spaces; hyphens and underscores stay."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^{fixed.WORD}-]+", " "))


def exact_hash(c) -> Column:
    return F.md5(F.lower(strip(c)))


def clean_metric_name(c) -> Column:
    return strip(F.regexp_replace(collapse_ws(strip(c)), r"[ ,]+[\p{Nd}, ]+\z", ""))


def clean_cell_value(c, preserve_thousands: bool = False) -> Column:
    """Drop a trailing footnote number. That also cuts ``1,000`` to ``1``; with
    ``preserve_thousands`` a well-formed grouped number stays whole."""
    flat = collapse_ws(strip(c))
    cut = strip(F.regexp_replace(flat, r"[ ,]+[\p{Nd},]+\z", ""))
    if preserve_thousands:
        return F.when(flat.rlike(r"(?:^|[^\p{Nd},])\p{Nd}{1,3}(?:,\p{Nd}{3})+\z"), flat).otherwise(cut)
    return cut


def stem(filename) -> Column:
    """File name without directory and last extension, as given."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def dashed_stem(filename) -> Column:
    return F.replace(F.lower(stem(filename)), F.lit("_"), F.lit("-"))


def basename(path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def gram_codes(flat: str) -> np.ndarray:
    """Distinct character 3-grams of a text as sorted numbers of 63 bits."""
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if points.size < 3:
        return np.empty(0, np.uint64)
    shift = np.uint64(21)
    codes = ((points[:-2] << shift | points[1:-1]) << shift) | points[2:]
    codes.sort()
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of ``gram_codes``; two empty sets are equal, one empty is 0."""
    if not a.size and not b.size:
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = np.count_nonzero(both[1:] == both[:-1])
    return same / (both.size - same)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _of_neighbours(texts: pd.Series) -> pd.Series:
    def of_row(row):
        grams = [gram_codes(t) for t in row]
        return [jaccard(x, y) for x, y in zip(grams, grams[1:])]

    return texts.map(lambda row: None if row is None else of_row(row))


def neighbour_similarity(texts) -> Column:
    """Jaccard of the 3-grams of each text of an array and the next one; case and
    repeated white space don't count. A text's 3-grams are found once, in time
    proportional to its length."""
    return _of_neighbours(F.transform(texts, lambda t: collapse_ws(F.lower(strip(t)))))


def chunk_id(doc_name, page, text) -> Column:
    return F.md5(F.concat_ws("|", doc_name, page.cast("string"), text))
