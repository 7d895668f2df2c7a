"""Application and protocol tags of catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.functions.tags import split_tags
from quotewright.functions.values import fill_null
from quotewright.schemas import ALL_APPLICATIONS, ALL_PROTOCOLS, BOOK


def _tags(raw: DataFrame, *names: str) -> DataFrame:
    return raw.select(
        BOOK, *names,
        split_tags(fill_null(F.col("application"), ALL_APPLICATIONS)).alias("application"),
        split_tags(fill_null(F.col("protocol"), ALL_PROTOCOLS)).alias("protocol"),
    )


def item_tags(raw: DataFrame) -> DataFrame:
    """One row per raw row, unpriced ones included; no tag means the wildcard."""
    return _tags(raw, "brand", "item")


def service_tags(raw: DataFrame) -> DataFrame:
    return _tags(raw, "service")
