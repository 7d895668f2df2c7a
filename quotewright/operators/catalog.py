"""Catalog prices under every surcharge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.schemas import BOOK


def _item_price(multiplier: Column) -> Column:
    flat = F.col("base_cost") + F.col("add_cost")
    return F.when(F.col("is_constant"), flat).when(
        ~F.col("is_constant"), F.col("base_cost") * multiplier + F.col("add_cost"))


def _service_price(multiplier: Column) -> Column:
    return F.col("base_price") * multiplier


def price_items_long(items: DataFrame, multipliers: DataFrame) -> DataFrame:
    """One row per item and label of its book."""
    return (
        items.join(multipliers, BOOK)
        .select(*items.columns, "label", "label_ix", _item_price(F.col("multiplier")).alias("price"))
    )


def price_services_long(services: DataFrame, multipliers: DataFrame) -> DataFrame:
    return (
        services.join(multipliers, BOOK)
        .select(*services.columns, "label", "label_ix",
                _service_price(F.col("multiplier")).alias("price"))
    )


def label_names(multipliers: DataFrame) -> list[str]:
    """Distinct labels in sheet order, as names for the columns of a wide catalog.

    They are brought to the driver: call it for the books a wide catalog is meant for. Many
    books with labels of their own fit :func:`price_items_by_label`.
    """
    rows = multipliers.groupBy("label").agg(F.min("label_ix").alias("first")).orderBy("first", "label")
    return [r["label"] for r in rows.collect()]


def _by_label(catalog: DataFrame, multipliers: DataFrame, price) -> DataFrame:
    """Labels are collected per book, and so are as many as one sheet has."""
    own = F.sort_array(F.collect_list(F.struct("label_ix", "label", "multiplier")))
    per_book = multipliers.groupBy(BOOK).agg(own.alias("__labels"))
    prices = F.transform("__labels", lambda m: F.struct(
        m["label"].alias("label"), price(m["multiplier"]).alias("price")))
    return catalog.join(per_book, BOOK, "left").withColumn(
        "prices", F.coalesce(prices, F.array())).drop("__labels")


def price_items_by_label(items: DataFrame, multipliers: DataFrame) -> DataFrame:
    """One row per item with ``prices``, an array of (label, price) in the order of its book."""
    return _by_label(items, multipliers, _item_price)


def price_services_by_label(services: DataFrame, multipliers: DataFrame) -> DataFrame:
    return _by_label(services, multipliers, _service_price)


def _wide(catalog: DataFrame, multipliers: DataFrame, labels: Sequence[str],
          price, keep: Sequence[Column]) -> DataFrame:
    """The multipliers are pivoted, one row per book, and not the catalog: its rows meet
    all their label columns in a single join."""
    labels = list(labels)
    if not labels:
        return catalog.select(*keep)
    per_book = multipliers.groupBy(BOOK).pivot("label", labels).agg(
        F.max(F.struct("multiplier"))).withColumnsRenamed(
        {label: f"__{i}" for i, label in enumerate(labels)})
    prices = [
        F.when(F.col(f"__{i}").isNotNull(), price(F.col(f"__{i}.multiplier"))).alias(label)
        for i, label in enumerate(labels)
    ]
    return catalog.join(per_book, BOOK, "left").select(*keep, *prices)


def price_items_wide(items: DataFrame, multipliers: DataFrame,
                     labels: Sequence[str]) -> DataFrame:
    """One price column for each of ``labels``; NULL where the book does not have the label."""
    keep = [F.col(BOOK), F.col("product_code").alias("code"), F.col("brand"), F.col("item"),
            F.col("description")]
    return _wide(items, multipliers, labels, _item_price, keep)


def price_services_wide(services: DataFrame, multipliers: DataFrame,
                        labels: Sequence[str]) -> DataFrame:
    keep = [F.col(c) for c in (BOOK, "grp", "service", "description")]
    return _wide(services, multipliers, labels, _service_price, keep)
