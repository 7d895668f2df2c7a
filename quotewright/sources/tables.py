"""Price books from tables, from text files or from workbooks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.cleaning import (
    clean_discounts, clean_items, clean_services, picked_columns,
)
from quotewright.operators.surcharges import item_multipliers, service_multipliers
from quotewright.operators.tagging import item_tags, service_tags
from quotewright.schemas import (
    BOOK, RAW_SCHEMAS, ROW, SHEET_HEADERS, SHEET_POSITIONS, SHEETS, PriceBook,
)


def trimmed(df: DataFrame) -> DataFrame:
    """All columns but the row number as text, without surrounding blanks; an empty cell is
    a missing one."""
    def cell(name: str):
        c = F.col(f"`{name}`")
        if name == ROW:
            return c.cast("long").alias(name)
        return F.nullif(F.trim(c.cast("string")), F.lit("")).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def read_sheet(spark: SparkSession, path: str, sheet: str, fmt: str = "csv") -> DataFrame:
    """One raw sheet. Files hold ``book_id`` and ``row_ix`` (sheet order), then the sheet's
    own columns. CSV and Parquet bring their own column names, so columns beyond those of
    the format do no harm; no file is read to guess types."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # Quoted text may hold line breaks and doubled quotes.
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    elif fmt == "json":
        reader = reader.schema(RAW_SCHEMAS[sheet])
    df = trimmed(reader.load(path))
    own = [c for c in df.columns if c not in (BOOK, ROW)]
    return df.select(
        BOOK, ROW,
        *picked_columns(own, SHEET_POSITIONS[sheet]),
        *[F.col(header).alias(name) for name, header in SHEET_HEADERS[sheet].items()],
    )


def price_book(raw: Mapping[str, DataFrame], as_of: dt.date | None = None) -> PriceBook:
    """The clean tables of raw sheets that are DataFrames already."""
    return PriceBook(
        items=clean_items(raw["prices"]),
        services=clean_services(raw["services"]),
        item_multipliers=item_multipliers(raw["surcharges"]),
        service_multipliers=service_multipliers(raw["surcharges"]),
        item_tags=item_tags(raw["prices"]),
        service_tags=service_tags(raw["services"]),
        discounts=clean_discounts(raw["discounts"], as_of),
    )


def read_price_book(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv",
                    as_of: dt.date | None = None) -> PriceBook:
    return price_book({s: read_sheet(spark, paths[s], s, fmt) for s in SHEETS}, as_of)


def write_price_book(book: PriceBook, path: str) -> None:
    """Store the clean tables once for all quotes. Files are cut and sorted by book, so a
    reader that names some books skips the rest by the statistics in the files, and a
    large book spans several files."""
    for name in PriceBook.__dataclass_fields__:
        df = getattr(book, name)
        second = next(c for c in (ROW, "label_ix", "item", "service") if c in df.columns)
        df.repartitionByRange(BOOK, second).sortWithinPartitions(BOOK, second).write.mode(
            "overwrite").parquet(f"{path}/{name}")


def load_price_book(spark: SparkSession, path: str) -> PriceBook:
    """Stored clean tables. Their file sizes are what Spark goes by when it decides whether
    a table is small enough to broadcast."""
    return PriceBook(**{n: spark.read.parquet(f"{path}/{n}") for n in PriceBook.__dataclass_fields__})


def counts(book: PriceBook) -> DataFrame:
    """Rows per clean table and price book."""
    parts = [
        getattr(book, name).groupBy(BOOK).agg(F.count("*").alias("n"))
        .select(BOOK, F.lit(name).alias("table_name"), "n")
        for name in book.__dataclass_fields__
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
