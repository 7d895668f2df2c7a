"""Surcharge multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotewright.functions.values import is_set, number, plain_number
from quotewright.operators.cleaning import surcharge_rows
from quotewright.schemas import BOOK, PRICE_LIST, PROCESSING, ROW

# What the two multipliers of a quote are called.
ITEM_CATEGORY = "Items (Consumables)"
SERVICE_CATEGORY = "Processing Services"


def _last_wins(rows: DataFrame, value: str) -> DataFrame:
    """One row per label: the value of its last row, the place of its first. A label
    that is NULL or empty cannot be selected, so it has no entry."""
    return (
        rows.where(is_set(F.col("label")))
        .groupBy(BOOK, "label")
        .agg(F.max_by(value, ROW).alias("multiplier"), F.min(ROW).alias("label_ix"))
    )


def item_multipliers(raw: DataFrame) -> DataFrame:
    rows = surcharge_rows(raw, PRICE_LIST)
    return _last_wins(rows.withColumn("amount", number(rows, "amount")), "amount")


def running_product(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Product of ``value`` from the first row of the book up to each row, in sheet
    order; NULL from the first NULL on.

    Rounding makes a product depend on its order, so the rows of a book are multiplied one
    after the other in one task. They stream through it and spill; a sheet of a workbook has
    at most 2^20 rows. Books run side by side.
    """
    so_far = W.partitionBy(BOOK).orderBy(ROW).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.when(~F.max(F.col(value).isNull()).over(so_far), F.product(value).over(so_far))
    return rows.withColumn(out, whole)


def service_multipliers(raw: DataFrame) -> DataFrame:
    """Processing surcharges stack: each label stands for the product up to its row."""
    rows = surcharge_rows(raw, PROCESSING)
    rows = rows.withColumn("amount", number(rows, "amount"))
    return _last_wins(running_product(rows, "amount", "cumulative"), "cumulative")


def surcharge_labels(multipliers: DataFrame) -> DataFrame:
    """Labels of each book in sheet order."""
    return multipliers.select(BOOK, "label_ix", "label").orderBy(BOOK, "label_ix")


def named_multipliers(quotes: DataFrame, items: DataFrame, services: DataFrame) -> DataFrame:
    """Add each quote's two multipliers, and whether its book knows the label (``item_known``, ``service_known``; else NULL)."""

    def side(multipliers: DataFrame, prefix: str) -> DataFrame:
        return multipliers.select(
            BOOK, F.col("label").alias(f"{prefix}_surcharge"),
            F.col("multiplier").alias(f"{prefix}_mult"), F.lit(True).alias(f"{prefix}_known"),
        )

    return (
        quotes.join(side(items, "item"), [BOOK, "item_surcharge"], "left")
        .join(side(services, "service"), [BOOK, "service_surcharge"], "left")
    )


def with_multipliers(quotes: DataFrame, items: DataFrame, services: DataFrame) -> DataFrame:
    """Add each quote's two multipliers. ``priceable`` is true when both surcharges are
    set and known; a known label may still have a NULL multiplier."""
    return (
        named_multipliers(quotes, items, services)
        .withColumn("configured",
                    is_set(F.col("item_surcharge")) & is_set(F.col("service_surcharge")))
        .withColumn("priceable", F.col("configured") & F.coalesce("item_known", F.lit(False))
                    & F.coalesce("service_known", F.lit(False)))
        .drop("item_known", "service_known")
    )


def surcharge_rejects(quotes: DataFrame, items: DataFrame, services: DataFrame) -> DataFrame:
    """Quotes that name a surcharge their price book does not have."""
    return with_multipliers(quotes, items, services).where(
        F.col("configured") & ~F.col("priceable")
    ).select("quote_id", BOOK, "item_surcharge", "service_surcharge",
             F.lit("unknown surcharge").alias("reason"))


def multiplier_reference(quotes: DataFrame, items: DataFrame, services: DataFrame) -> DataFrame:
    """Two rows per quote that has both surcharges: what its prices are multiplied by."""

    def entry(ord_: int, category: str, value: str):
        shown = F.coalesce(plain_number(F.round(value, 3)), F.lit("NA"))
        return F.struct(F.lit(ord_).alias("ord"), F.lit(category).alias("category"),
                        F.concat(F.lit("x"), shown).alias("multiplier"))

    rows = F.array(entry(1, ITEM_CATEGORY, "item_mult"),
                   entry(2, SERVICE_CATEGORY, "service_mult"))
    return (
        with_multipliers(quotes.select("quote_id", BOOK, "item_surcharge", "service_surcharge"),
                         items, services)
        .where("priceable")
        .select("quote_id", F.inline(rows))
    )
