"""Predicates over table labels, cell values and product codes."""
from pyspark.sql import Column, functions as F

from docmill import fixed
from docmill.functions.text import clean_metric_name, let, normalise_label, strip


def is_generic_header(c) -> Column:
    return normalise_label(c).isin(fixed.GENERIC_HEADERS)


def is_section_label(c) -> Column:
    return normalise_label(c).isin(fixed.SECTION_LABELS)


def is_component_code(c) -> Column:
    return strip(c).rlike(fixed.COMPONENT)


def is_placeholder(c) -> Column:
    return strip(c).rlike(r"^(?i:col)\p{Nd}+\z")


def is_blank(c) -> Column:
    return F.lower(c).isin(fixed.BLANK_VALUES)


def is_separator_cell(c) -> Column:
    return c.rlike(rf"^[{fixed.WS}\-:+]+\z")


def is_spec_value(c) -> Column:
    return let(
        strip(c),
        lambda s: ~is_placeholder(s) & ~is_blank(s)
        & (s.rlike(r"\p{Nd}") | normalise_label(s).isin(fixed.WORDED_VALUES)),
    )


def is_metric_label(c, models_in) -> Column:
    """``models_in`` maps a cell column to the array of models found in it."""
    return let(
        clean_metric_name(c),
        lambda s: (s != "") & ~is_placeholder(s) & ~is_blank(s) & ~is_generic_header(s) & ~is_section_label(s)
        & (F.regexp_count(s, F.lit("[A-Za-z]")) >= 3)
        & (F.regexp_count(s, F.lit("[A-Za-z]")) >= F.regexp_count(s, F.lit(r"\p{Nd}")))
        & (F.size(models_in(s)) == 0),
    )


def is_valid_model(c) -> Column:
    known = [h for h in fixed.GENERIC_HEADERS if h not in fixed.GENERIC_TABLE_ONLY]
    return let(
        strip(c),
        lambda m: (F.length(m) >= 4)
        & ~normalise_label(m).isin(known)
        & m.rlike(r"\p{Nd}")
        & ~m.rlike(fixed.BLOCKED_MODEL)
        & ~F.upper(m).isin(fixed.FAMILY_DESIGNATORS)
        & m.rlike(fixed.CODE_FULL),
    )


def is_noise_line(c) -> Column:
    return c.rlike(rf"^[{fixed.WS}\p{{Nd}}.\-_|]{{0,6}}\z")
