"""Bitmaps of catalog rows by tag key and by filter value, and the rows that selections leave.

A book's rows are numbered by ``row_ix``; 64 neighbours are one chunk, whose rows are the bits of a long
integer (``word``). A selection's tags give the OR of the words of its tag keys, each filter that is set
one more word to AND; so a selection costs as many words as its book has chunks, whatever number of
quotes make it, and quotes meet no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.operators.joins import null_safe_join
from quotewright.schemas import ALL, BOOK, ROW

BITS = 64
NO_CHUNK = -1  # of the word that only tells that a tag key exists; row numbers are not negative
TAG_KEYS = ["app_key", "proto_key"]
TAG_CHOICES = [BOOK, "application", "protocol"]


def _chunk() -> Column:
    return F.floor(F.col(ROW) / BITS).alias("chunk")


def _words() -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(ROW), F.lit(BITS)).cast("int"))
    return F.bit_or(bit).alias("word")


def tag_bitmaps(catalog: DataFrame, keyed: DataFrame, name: Sequence[str]) -> DataFrame:
    """(book, tag key, chunk, word) of the catalog rows whose name has the key.

    ``keyed`` has rows of names and tag keys. A key of names without catalog rows gets an empty word. A name's
    distinct keys are gathered first, so that a name often repeated in both tables meets its rows once.
    """
    named = keyed.groupBy(BOOK, *name).agg(F.collect_set(F.struct(*TAG_KEYS)).alias("__keys"))
    rows = null_safe_join(named, catalog.select(BOOK, *name, ROW), [BOOK, *name], "left").select(
        BOOK, ROW, F.inline("__keys"))
    return rows.groupBy(BOOK, *TAG_KEYS, F.coalesce(_chunk(), F.lit(NO_CHUNK)).alias("chunk")).agg(
        F.coalesce(_words(), F.lit(0)).alias("word"))


def value_bitmaps(catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(book, facet, value, chunk, word) of the values of ``columns``; the facet ``All`` has all rows."""
    facets = F.array(F.struct(F.lit(ALL).alias("facet"), F.lit(ALL).alias("value")), *[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        catalog.select(BOOK, ROW, F.inline(facets)).where("value IS NOT NULL")
        .groupBy(BOOK, "facet", "value", _chunk()).agg(_words())
    )


def selected(selections: DataFrame, selection_keys: DataFrame, by_tag: DataFrame, by_value: DataFrame,
             filters: Mapping[str, str]) -> DataFrame:
    """``selections`` (book, application, protocol, a column per filter) with ``chunk`` and ``word`` of the rows
    they show; chunks without rows may be missing.

    ``selection_keys`` has the tag keys that satisfy each (book, application, protocol); one of which no
    key exists shows all rows of its book. ``filters`` are the filters' columns and the catalog's.
    """
    by_tags = (
        selection_keys.join(by_tag, [BOOK, *TAG_KEYS]).groupBy(*TAG_CHOICES, "chunk").agg(F.bit_or("word").alias("word")))
    everything = by_value.where(F.col("facet") == ALL).select(BOOK, "chunk", "word")
    shown = selections.join(by_tags, TAG_CHOICES, "left")
    whole = everything.withColumnsRenamed({"chunk": "__chunk", "word": "__word"})
    untagged = shown.where("chunk IS NULL").drop("chunk", "word").join(whole, BOOK).withColumnsRenamed(
        {"__chunk": "chunk", "__word": "word"})
    shown = shown.where(F.col("chunk") != NO_CHUNK).unionByName(untagged)
    for choice, column in filters.items():
        words = by_value.where(F.col("facet") == column).select(
            BOOK, F.col("value").alias(choice), "chunk", F.col("word").alias("__word"))
        free = F.coalesce(F.col(choice) == ALL, F.lit(False))
        kept = F.when(free, F.col("word")).otherwise(F.col("word").bitwiseAND(F.col("__word")))
        shown = shown.join(words, [BOOK, choice, "chunk"], "left").withColumn(
            "word", F.coalesce(kept, F.lit(0).cast("long"))).drop("__word")
    return shown.where("word <> 0")


def rows_of(words: DataFrame) -> DataFrame:
    """One row per bit of ``words``, with its row number in place of ``chunk`` and ``word``."""
    others = [c for c in words.columns if c not in ("chunk", "word")]
    bit = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)),
                   lambda b: F.call_function("shiftrightunsigned", F.col("word"), b).bitwiseAND(1) == 1)
    return words.select(*others, (F.col("chunk") * BITS).alias("__first"), F.explode(bit).alias("__bit")).select(
        *others, (F.col("__first") + F.col("__bit")).alias(ROW))
