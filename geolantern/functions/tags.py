"""Tag dictionaries: parsing, text forms and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY_TEXT, PRIORITY_KEYS
from .text import strip

TAGS_TYPE = "map<string,string>"


def parse_tags(raw) -> Column:
    """Tag dictionary of a JSON object text; missing or malformed text gives an empty one."""
    return F.coalesce(F.from_json(raw, TAGS_TYPE), F.create_map().cast(TAGS_TYPE))


def has_key(tags, key) -> Column:
    """Key existence. A whole sentence as key is an ordinary, usually absent, key."""
    return F.map_contains_key(tags, key)


def has_pair(tags, key, value) -> Column:
    """Containment of one key and value."""
    return F.try_element_at(tags, F.lit(key)) == F.lit(value)


def _entries_text(tags) -> Column:
    # A JSON null prints as its Python name.
    return F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))
    )), "; ")


def tag_text(tags, variant: str = "all", empty: str = EMPTY_TEXT) -> Column:
    """``k: v; k: v`` in entry order.

    ``variant`` is ``all`` for every entry or ``scalar`` for trimmed, non-blank values.
    """
    tags = F.col(tags) if isinstance(tags, str) else tags
    if variant == "scalar":
        trimmed = F.transform_values(tags, lambda k, v: strip(v))
        tags = F.map_filter(trimmed, lambda k, v: v != "")
    elif variant != "all":
        raise ValueError(f"unknown variant {variant!r}")
    text = _entries_text(tags)
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, text).otherwise(F.lit(empty))


def concat_text(*columns, sep: str = "; ", empty: str = EMPTY_TEXT) -> Column:
    """Text of several columns: dictionaries as entry text, strings trimmed, NULLs skipped."""
    parts = []
    for col in columns:
        value = F.col(col) if isinstance(col, str) else col
        stripped = strip(value)
        entries = _entries_text(parse_tags(value))
        part = F.when(stripped.startswith("{"), entries).otherwise(stripped)
        parts.append(F.when(part != "", part))
    joined = F.concat_ws(sep, *parts)
    return F.when(strip(joined) != "", joined).otherwise(F.lit(empty))


def tags_json(tags) -> Column:
    """The dictionary rendered as one string, for metrics over result tags."""
    return F.to_json(tags)


def priority_tag(tags, keys=PRIORITY_KEYS) -> Column:
    """Struct (key, value) of the first listed key with a non-blank value, else NULL."""
    options = []
    for key in keys:
        value = strip(F.try_element_at(tags, F.lit(key)))
        options.append(F.when(value != "", F.struct(F.lit(key).alias("key"), value.alias("value"))))
    return F.coalesce(*options)
