"""Tag lists written as ``;``-separated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotewright.schemas import ALL, TAG_SEPARATOR


def split_tags(c: Column) -> Column:
    """Pieces between separators, untrimmed; one trailing empty piece is dropped and
    empty text has no pieces at all."""
    body = F.when(c.endswith(TAG_SEPARATOR), F.left(c, F.length(c) - 1)).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(body, TAG_SEPARATOR, -1)
    )


def matches_tag(tags: Column, selected: Column | str, wildcard: str) -> Column:
    """True when ``selected`` is 'All', or is one of the tags, or the wildcard is."""
    if isinstance(selected, str):
        if selected == ALL:
            return F.lit(True)
        selected = F.lit(selected)
    found = F.array_contains(tags, selected) | F.array_contains(tags, F.lit(wildcard))
    return F.coalesce((selected == ALL) | found, F.lit(False))
