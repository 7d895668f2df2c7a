"""Price books that are uploaded again and again.

An upload replaces the books it holds. What it holds is told from what is stored by a digest per book and sheet, so only
sheets that changed are cleaned and written. Every upload that changes something is a version; a manifest names,
for each book and sheet, the version whose files hold it, so older versions stay readable and share files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.schemas import BOOK, ROW, SHEETS, PriceBook
from quotewright.sources.digests import digests, row_hash
from quotewright.sources.marks import is_done, last_done, mark_done
from quotewright.sources.tables import price_book

# The clean tables that come from each sheet.
TABLES = {
    "prices": ("items", "item_tags"), "services": ("services", "service_tags"),
    "surcharges": ("item_multipliers", "service_multipliers"), "discounts": ("discounts",),
}


def sheet_digests(raw: Mapping[str, DataFrame], as_of: dt.date) -> DataFrame:
    """``book_id``, ``sheet``, ``digest`` of every book that has rows in any sheet, four rows each.

    A sheet's digest does not depend on the order of rows; a row's number is part of it. That of
    the discounts covers ``as_of``, since what is in force changes by the day. Rows without a ``book_id`` belong to no book.
    """
    def rows(sheet: str) -> DataFrame:
        df = raw[sheet].where(F.col(BOOK).isNotNull())
        seed = as_of.isoformat() if sheet == "discounts" else ""
        columns = [c for c in df.columns if c != BOOK]
        return df.select(BOOK, F.lit(sheet).alias("sheet"), row_hash(columns, seed).alias("sha"))

    found = digests(reduce(DataFrame.unionByName, map(rows, SHEETS)), [BOOK, "sheet"])
    sheets = F.explode(F.array(*map(F.lit, SHEETS))).alias("sheet")
    every = found.select(BOOK).distinct().select(BOOK, sheets)
    return every.join(found, [BOOK, "sheet"], "left").fillna("empty", ["digest"])


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """``book_id``, ``sheet``, ``digest`` and ``stored``, the version whose files hold the sheet."""
    return spark.read.parquet(f"{store}/manifests/{_known(spark, store, version)}")


def _known(spark: SparkSession, store: str, version: int | None) -> int:
    found = last_done(spark, store) if version is None else version
    if not is_done(spark, store, found):
        raise ValueError(f"{store} holds no version {found or ''}".rstrip())
    return found


def publish(spark: SparkSession, raw: Mapping[str, DataFrame], store: str, as_of: dt.date | None = None) -> int:
    """Take an upload of raw sheets into the folder ``store``; the number of the version that then holds it.

    Books of the upload replace those stored, with all four sheets, also empty ones; other books stay. An
    upload that changes nothing makes no version. A version is visible once it is whole: its mark is written last, and one lost
    before that is written again by the next upload. Uploads to one store run one at a time; readers at any time.
    ``as_of`` (today if not given) decides which discounts are in force.
    """
    as_of = as_of or spark.range(1).select(F.current_date()).first()[0]
    last = last_done(spark, store)
    version = last + 1
    found = sheet_digests(raw, as_of)
    if last:
        before = manifest(spark, store, last).select(BOOK, "sheet", F.col("digest").alias("__digest"), "stored")
        both = found.join(before, [BOOK, "sheet"], "full")
        same = F.col("digest").isNull() | F.coalesce(F.col("digest") == F.col("__digest"), F.lit(False))
        found = both.select(BOOK, "sheet", F.coalesce("digest", "__digest").alias("digest"),
                            F.when(same, F.col("stored")).otherwise(version).cast("long").alias("stored"))
    else:
        found = found.withColumn("stored", F.lit(version).cast("long"))
    found.write.mode("overwrite").parquet(f"{store}/manifests/{version}")
    changed = spark.read.parquet(f"{store}/manifests/{version}").where(F.col("stored") == version)
    if last and changed.isEmpty():
        return last
    sheets = {s: raw[s].join(changed.where(F.col("sheet") == s).select(BOOK), BOOK, "left_semi").select(*raw[s].columns)
              for s in SHEETS}
    clean = price_book(sheets, as_of)
    for names in TABLES.values():
        for name in names:
            df = getattr(clean, name)
            second = next(c for c in (ROW, "label_ix", "item", "service") if c in df.columns)
            df.repartitionByRange(BOOK, second).sortWithinPartitions(BOOK, second).write.mode("overwrite").parquet(
                f"{store}/tables/{name}/stored={version}")
    mark_done(spark, store, version)
    return version


def published_book(spark: SparkSession, store: str, version: int | None = None) -> PriceBook:
    """The clean tables of a version, the last one if not given. Files of later versions are not read, nor
    listed as rows: a version being written does no harm."""
    version = _known(spark, store, version)
    held = manifest(spark, store, version)

    def table(sheet: str, name: str) -> DataFrame:
        wanted = held.where(F.col("sheet") == sheet).select(BOOK, "stored")
        files = spark.read.parquet(f"{store}/tables/{name}").where(F.col("stored") <= version)
        columns = [c for c in files.columns if c != "stored"]
        return files.join(wanted, [BOOK, "stored"], "left_semi").select(*columns)

    return PriceBook(**{name: table(sheet, name) for sheet, names in TABLES.items() for name in names})
