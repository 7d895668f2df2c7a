"""Which catalog rows a selection shows, for one selection or for every quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.tags import matches_tag
from quotewright.functions.values import is_set
from quotewright.operators.bitmaps import rows_of, selected, tag_bitmaps, value_bitmaps
from quotewright.operators.joins import null_safe_join
from quotewright.schemas import ALL, ALL_APPLICATIONS, ALL_PROTOCOLS, BOOK, ROW

ITEM_NAME = ["brand", "item"]
SERVICE_NAME = ["service"]


def _filter_catalog(catalog: DataFrame, tags: DataFrame, name: Sequence[str],
                    equals: dict[str, str], application: str, protocol: str) -> DataFrame:
    """Catalog rows whose name has a tag row matching both selections. In a book where
    no tag row at all matches, the tags are ignored and every row stays."""
    for column, choice in equals.items():
        if choice != ALL:
            catalog = catalog.where(F.col(column) == choice)
    hits = (
        tags.where(matches_tag(F.col("application"), application, ALL_APPLICATIONS)
                   & matches_tag(F.col("protocol"), protocol, ALL_PROTOCOLS))
        .select(BOOK, *name).distinct()
    )
    matched_books = hits.select(BOOK).distinct().withColumn("__tagged", F.lit(True))
    flagged = null_safe_join(catalog, hits.withColumn("__hit", F.lit(True)), [BOOK, *name], "left")
    return (
        flagged.join(matched_books, BOOK, "left")
        .where(F.col("__hit") | F.col("__tagged").isNull())
        .select(*catalog.columns)
    )


def filter_items(items: DataFrame, tags: DataFrame, brand: str = ALL, category: str = ALL,
                 application: str = ALL, protocol: str = ALL) -> DataFrame:
    return _filter_catalog(items, tags, ITEM_NAME, {"brand": brand, "category": category},
                           application, protocol)


def filter_services(services: DataFrame, tags: DataFrame, group: str = ALL,
                    application: str = ALL, protocol: str = ALL) -> DataFrame:
    return _filter_catalog(services, tags, SERVICE_NAME, {"grp": group}, application, protocol)


# --- every quote at once -------------------------------------------------------------
#
# A quote's selection matches a tag row when one of its (application, protocol) keys is
# among the row's keys: a row carries the pairs of its tags, plus 'All' on either side; a
# selection looks for its own tag and the wildcard, or for 'All' alone. That turns the
# membership test into an equi-join.


def _row_keys(tags: DataFrame, name: Sequence[str]) -> DataFrame:
    def with_all(c: str) -> Column:
        return F.array_union(c, F.array(F.lit(ALL)))

    return (
        tags.select(BOOK, *name, F.explode(with_all("application")).alias("app_key"), "protocol")
        .select(BOOK, *name, "app_key", F.explode(with_all("protocol")).alias("proto_key"))
    )


def _selection_keys(selections: DataFrame) -> DataFrame:
    def keys(c: str, wildcard: str) -> Column:
        return F.explode(F.when(F.col(c) == ALL, F.array(F.lit(ALL))).otherwise(
            F.array_distinct(F.array(F.col(c), F.lit(wildcard)))))

    return (
        selections.select("*", keys("application", ALL_APPLICATIONS).alias("app_key"))
        .select("*", keys("protocol", ALL_PROTOCOLS).alias("proto_key"))
    )


def _selections(quotes: DataFrame, filters: Sequence[str]) -> DataFrame:
    """The distinct selections made in any quote: far fewer than quotes."""
    return (
        quotes.where(is_set(F.col("application")) & is_set(F.col("protocol")))
        .select(BOOK, "application", "protocol", *filters).distinct()
    )


def _with_rows(catalog: DataFrame) -> DataFrame:
    """A catalog without row numbers gets some; it is read more than once, so let it be a stored table."""
    return catalog if ROW in catalog.columns else catalog.withColumn(ROW, F.monotonically_increasing_id())


def _class_words(quotes: DataFrame, catalog: DataFrame, tags: DataFrame, name: Sequence[str],
                 filters: dict[str, str]) -> DataFrame:
    """The distinct selections of ``quotes`` with the bitmap of the catalog rows that each shows."""
    catalog, made = _with_rows(catalog), _selections(quotes, list(filters))
    keys = _selection_keys(made.select(BOOK, "application", "protocol").distinct())
    return selected(made, keys, tag_bitmaps(catalog, _row_keys(tags, name), name),
                    value_bitmaps(catalog, list(filters.values())), filters)


def _class_rows(quotes: DataFrame, catalog: DataFrame, tags: DataFrame, name: Sequence[str],
                filters: dict[str, str]) -> DataFrame:
    """One row per distinct selection and catalog row that it shows: the selection's columns and ``row_ix``.

    Quotes with the same selection share its rows: join them on the selection's columns to reach the rows of one.
    """
    return rows_of(_class_words(quotes, catalog, tags, name, filters))


def _eligible(quotes: DataFrame, catalog: DataFrame, tags: DataFrame, name: Sequence[str],
              filters: dict[str, str]) -> DataFrame:
    """Every quote with the rows of its selection."""
    selection = [BOOK, "application", "protocol", *filters]
    shown = _class_rows(quotes, catalog, tags, name, filters).join(
        _with_rows(catalog).withColumnsRenamed({c: f"__{c}" for c in selection if c in catalog.columns and c != BOOK}), [BOOK, ROW])
    return quotes.select("quote_id", *selection).join(shown, selection).select(
        "quote_id", *[F.col(f"__{c}").alias(c) if c in selection and c != BOOK else F.col(c) for c in catalog.columns])


ITEM_FILTERS = {"brand_filter": "brand", "category_filter": "category"}
SERVICE_FILTERS = {"group_filter": "grp"}


def eligible_item_classes(quotes: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows that each distinct selection of ``quotes`` shows: ``book_id``, ``application``, ``protocol``,
    ``brand_filter``, ``category_filter`` and ``row_ix``. ``row_ix`` is unique in a book and not negative."""
    return _class_rows(quotes, items, tags, ITEM_NAME, ITEM_FILTERS)


def eligible_service_classes(quotes: DataFrame, services: DataFrame, tags: DataFrame) -> DataFrame:
    """The same for services, with ``group_filter``."""
    return _class_rows(quotes, services, tags, SERVICE_NAME, SERVICE_FILTERS)


def eligible_items(quotes: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per quote and item it may pick. This output is as large as it sounds: quotes share
    the rows of :func:`eligible_item_classes`, and :func:`eligible_item_counts` has their number."""
    return _eligible(quotes, items, tags, ITEM_NAME, ITEM_FILTERS)


def eligible_services(quotes: DataFrame, services: DataFrame, tags: DataFrame) -> DataFrame:
    return _eligible(quotes, services, tags, SERVICE_NAME, SERVICE_FILTERS)


def _eligible_counts(quotes: DataFrame, catalog: DataFrame, tags: DataFrame, name: Sequence[str],
                     filters: dict[str, str]) -> DataFrame:
    """Number of eligible catalog rows per quote: the bits of its selection."""
    selection = [BOOK, "application", "protocol", *filters]
    answers = _class_words(quotes, catalog, tags, name, filters).groupBy(*selection).agg(
        F.sum(F.bit_count("word")).alias("n"))
    return (
        quotes.select("quote_id", *selection).join(answers, selection, "left")
        .select("quote_id", F.coalesce("n", F.lit(0)).alias("n_eligible"))
    )


def eligible_item_counts(quotes: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    return _eligible_counts(quotes, items, tags, ITEM_NAME, ITEM_FILTERS)


def eligible_service_counts(quotes: DataFrame, services: DataFrame, tags: DataFrame) -> DataFrame:
    return _eligible_counts(quotes, services, tags, SERVICE_NAME, SERVICE_FILTERS)


# --- choice lists --------------------------------------------------------------------


def _choices(values: DataFrame, wildcard: str | None = None) -> DataFrame:
    """Sorted distinct values of each book, with 'All' in front of them."""
    entry = F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit(ALL).alias("choice")),
        F.struct(F.lit(1).alias("ord"), F.col("choice").alias("choice")),
    ))
    rows = values.select(BOOK, entry).where(F.col("choice").isNotNull())
    if wildcard:
        rows = rows.where(F.col("choice") != wildcard)
    return rows.distinct().orderBy(BOOK, "ord", "choice")


def application_choices(items: DataFrame, services: DataFrame) -> DataFrame:
    """Applications that can be chosen, from both tag tables."""
    def tags(df: DataFrame) -> DataFrame:
        return df.select(BOOK, F.explode_outer("application").alias("choice"))

    return _choices(tags(items).unionByName(tags(services)), ALL_APPLICATIONS)


def protocol_choices(items: DataFrame, services: DataFrame, application: str = ALL) -> DataFrame:
    """Protocols offered once an application is chosen. Only rows that name the
    application count here; rows with the wildcard do not."""
    def tags(df: DataFrame) -> DataFrame:
        named = F.lit(True) if application == ALL else F.array_contains("application", application)
        return df.select(
            BOOK, F.explode_outer(F.when(named, F.col("protocol"))).alias("choice"))

    return _choices(tags(items).unionByName(tags(services)), ALL_PROTOCOLS)


def choice_list(df: DataFrame, column: str, first: str = ALL) -> DataFrame:
    """Sorted distinct non-NULL values of a column, per book, after the entry that restricts
    nothing: ``All`` for filters, an empty text for discounts and surcharges."""
    entries = F.array(F.struct(F.lit(0).alias("ord"), F.lit(first).alias("choice")),
                      F.struct(F.lit(1).alias("ord"), F.col("value").alias("choice")))
    values = df.select(BOOK, F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return values.select(BOOK, F.inline(entries)).distinct().orderBy(BOOK, "ord", "choice")
