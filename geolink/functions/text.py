"""Text helpers: superscripts in units, metadata tags, indicator cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN, _RAISED = "0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ"


def superscript(unit: Column) -> Column:
    """``m s**-1`` to ``m s⁻¹``: the digits after a double star, up to the next blank, are raised."""
    parts = F.split(unit, r"\*\*")
    raised = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.translate(F.regexp_extract(p, r"^(\S*)", 1), _PLAIN, _RAISED), F.regexp_replace(p, r"^\S*", ""))))
    return F.array_join(raised, "")


def clean_tags(tags: Column) -> Column:
    """Keep the entries of a string map whose key and value are plain words."""
    word = "^[A-Za-z0-9._-]*$"
    return F.map_filter(tags, lambda k, v: k.rlike(word) & v.rlike(word))


#: Fields of an indicator card and their labels.
CARD = (
    ("name", "Indicator"), ("category", "Category"), ("data_type", "Data type"), ("unit", "Unit"), ("spatial_resolution", "Spatial resolution"),
    ("spatial_coverage", "Spatial coverage"), ("temporal_resolution", "Temporal resolution"), ("temporal_coverage", "Temporal coverage"),
)


def indicator_card(lists: tuple[str, ...] = ("temporal_resolution",)) -> Column:
    """Eight labelled lines: values aligned to the right of the labels, N/A for none, bullets for several."""
    width = max(len(label) for _, label in CARD)
    lines = []
    for field, label in CARD:
        pad = " " * (width - len(label))
        if field in lists:
            many = F.concat(F.lit("- "), F.array_join(F.col(field), "\n" + " " * (width + 2) + "- "))
            value = F.when(F.coalesce(F.size(field), F.lit(0)) < 1, F.lit(pad + "N/A")).when(F.size(field) == 1, F.concat(F.lit(pad), F.get(F.col(field), F.lit(0)))).otherwise(many)
        else:
            value = F.concat(F.lit(pad), F.coalesce(F.col(field), F.lit("N/A")))
        lines.append(F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", *lines)
