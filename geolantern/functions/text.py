"""Query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PREPOSITIONS, WHITESPACE


def strip(text) -> Column:
    """Remove white space of any kind on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def after_preposition(text, prepositions=PREPOSITIONS) -> Column:
    """Lower-cased text after the first preposition of the list that occurs.

    List order decides, not text order. Text without a match keeps its case; NULL
    counts as empty.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lowered = F.lower(text)
    out = None
    for word in prepositions:
        pattern = rf"(?d)(?<![\p{{L}}\p{{N}}_]){word} (.+)"
        hit, tail = F.regexp_like(lowered, F.lit(pattern)), strip(F.regexp_extract(lowered, pattern, 1))
        out = F.when(hit, tail) if out is None else out.when(hit, tail)
    return out.otherwise(text)
