"""Look-ups by a key of which a few values may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HEAVY = 1000


def look_up(rows: DataFrame, found: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``found``, one row per ``key``; no task gets a hot key's rows.

    ``weight`` is the column of ``found`` with the number of ``rows`` that have the key, and ``total`` the
    number of all. Keys with more than a ``MOST_HEAVY``-th of the rows are fewer than ``MOST_HEAVY``,
    so these are broadcast at any size; all other keys are joined by a shuffle. ``rows`` is read twice.
    """
    heavy = F.col(weight) * MOST_HEAVY > total
    hot = F.broadcast(found.where(heavy))
    rest = rows.join(F.broadcast(found.where(heavy).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(found.where(~heavy), key, how))
