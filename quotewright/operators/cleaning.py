"""Cleaning of the raw sheets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotewright.functions.values import fill_null, number, plain_number, truthy
from quotewright.schemas import BOOK, ROW


def picked_columns(columns: Sequence[str], positions: Mapping[str, int]) -> list[Column]:
    """The columns at the given positions, under their new names."""
    return [F.col(f"`{columns[i]}`").alias(name) for name, i in positions.items()]


def positional(df: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """Pick columns by position and rename them, in the order given."""
    return df.select(*picked_columns(df.columns, positions))


def _item_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        BOOK, ROW, "product_code", "brand", "item", "category", "description",
        number(raw, "base_cost").alias("base_cost"),
        fill_null(number(raw, "add_cost"), 0.0).alias("add_cost"),
        truthy(raw, "is_constant").alias("is_constant"),
        # Written but not a number: such a row can be neither priced nor defaulted.
        (F.col("add_cost").isNotNull() & number(raw, "add_cost").isNull()).alias("bad_add_cost"),
        F.col("add_cost").cast("string").alias("add_cost_text"),
    ).where(F.col("base_cost").isNotNull())


def clean_items(raw: DataFrame) -> DataFrame:
    """Priced catalog rows. Rows without a usable base cost are dropped; rows whose
    extra cost is text that is no number go to :func:`item_rejects`."""
    return _item_columns(raw).where(~F.col("bad_add_cost")).drop("bad_add_cost", "add_cost_text")


def item_rejects(raw: DataFrame) -> DataFrame:
    return _item_columns(raw).where("bad_add_cost").select(
        BOOK, ROW, "product_code", "add_cost_text", F.lit("add_cost is not a number").alias("reason")
    )


def clean_services(raw: DataFrame) -> DataFrame:
    return raw.select(
        BOOK, ROW, "grp", "service", "description", number(raw, "base_price").alias("base_price")
    ).where(F.col("base_price").isNotNull())


# A date that starts with year, month and day; what follows, such as a time, is ignored.
DATE_PATTERN = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:\D.*)?$"
SERIAL_PATTERN = r"^\d{1,6}(\.\d+)?$"


def _end_date(raw: DataFrame) -> Column:
    c = F.col("end_date")
    if not isinstance(raw.schema["end_date"].dataType, T.StringType):
        return c.cast("date")
    # Workbooks store a date as the number of days since 1899-12-30.
    serial = F.date_add(F.lit(dt.date(1899, 12, 30)), F.floor(c.try_cast("double")).cast("int"))
    written = F.concat_ws("-", *[F.regexp_extract(c, DATE_PATTERN, i) for i in (1, 2, 3)])
    return F.when(c.rlike(SERIAL_PATTERN), serial).when(c.rlike(DATE_PATTERN), written.try_cast("date"))


def discount_display(supplier: Column, label: Column, amount: Column, kind: Column) -> Column:
    """'Supplier | Label | 15%' or 'Supplier | Label | $40'; a missing word prints as NA."""
    shown = F.when(kind == "percentage", F.concat(plain_number(amount * 100), F.lit("%"))).otherwise(
        F.concat(F.lit("$"), plain_number(amount))
    )
    return F.concat_ws(" | ", fill_null(supplier, "NA"), fill_null(label, "NA"), shown)


def _discount_columns(raw: DataFrame, as_of: dt.date | None) -> DataFrame:
    end_date, amount = _end_date(raw), number(raw, "amount")
    return raw.select(
        BOOK, ROW, "supplier", "label", amount.alias("amount"), F.lower("type").alias("type"),
        end_date.alias("end_date"), (F.lit(as_of) if as_of else F.current_date()).alias("today"),
        # Written but unreadable: such a row must not pass as one without an end.
        F.when(F.col("end_date").isNotNull() & end_date.isNull(), "end_date is not a date")
        .when(F.col("amount").isNotNull() & amount.isNull(), "amount is not a number").alias("reason"),
        F.col("end_date").cast("string").alias("end_date_text"), F.col("amount").cast("string").alias("amount_text"),
    )


def clean_discounts(raw: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Discounts in force on ``as_of`` (today if not given); no end date means open. Rows with
    an unreadable date or amount go to :func:`discount_rejects`."""
    return (
        _discount_columns(raw, as_of)
        .where(F.col("reason").isNull() & F.col("type").isNotNull() & (F.col("amount") > 0)
               & (F.coalesce("end_date", "today") >= F.col("today")))
        .select(BOOK, ROW, "supplier", "label", "amount", "type")
        .withColumn("display_text", discount_display(
            F.col("supplier"), F.col("label"), F.col("amount"), F.col("type")))
    )


def discount_rejects(raw: DataFrame) -> DataFrame:
    """Discount rows whose end date or amount is written but cannot be read."""
    return _discount_columns(raw, None).where(F.col("reason").isNotNull()).select(
        BOOK, ROW, "supplier", "end_date_text", "amount_text", "reason")


def surcharge_rows(raw: DataFrame, kind: str) -> DataFrame:
    return raw.where(F.col("type") == kind)
