"""What quotes would cost under other surcharges, without pricing their carts again.

A re-priced line's total is linear in the multiplier of its kind. So four sums per quote stand for its cart: what
no multiplier touches, what the item multiplier scales, what comes on top of that, and what the service
multiplier scales. Labels meet these sums, never the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.values import total
from quotewright.operators.surcharges import named_multipliers
from quotewright.schemas import BOOK, ITEM_LINE, PRICE_LIST, PROCESSING, SERVICE_LINE

SUMS = ["fixed", "item_scaled", "item_added", "service_scaled"]


def quote_factors(cart: DataFrame) -> DataFrame:
    """Per quote the sums (``SUMS``) from which its net total under any multipliers follows.

    Quantities and percentages count as they are, prices do not. A line whose quantity, percentage or reference price is
    NULL has no total and counts as nothing; so does one of another type, whose price is zero.
    """
    def net(price: Column) -> Column:
        gross = price * F.col("quantity")
        return gross - gross * (F.col("disc_pct") / 100.0)

    item, constant = F.col("type") == ITEM_LINE, F.col("is_constant")
    base, extra = F.col("base_ref"), F.col("add_ref")
    scaled = item & ~constant & base.isNotNull() & extra.isNotNull()
    return cart.groupBy("quote_id").agg(
        total(F.when(item & constant, net(base + extra))).alias("fixed"),
        total(F.when(scaled, net(base))).alias("item_scaled"),
        total(F.when(scaled, net(extra))).alias("item_added"),
        total(F.when(F.col("type") == SERVICE_LINE, net(base))).alias("service_scaled"))


def net_under(item_mult: Column, service_mult: Column) -> Column:
    """Net total from ``SUMS``. Where a multiplier is NULL, the lines that it scales have no total."""
    zero = F.lit(0.0)
    return (F.col("fixed") + F.coalesce(F.col("item_scaled") * item_mult + F.col("item_added"), zero)
            + F.coalesce(F.col("service_scaled") * service_mult, zero))


def to_cents(c: Column) -> Column:
    """Rounded to cents; what is within 10^-7 of half a cent counts as half and goes up, since sums of
    doubles that should meet a half miss it by less. From 10^15 on nothing is rounded."""
    return F.when(F.abs(c) < 1e15, F.floor(c * 100.0 + 0.50001).cast("double") / 100.0).otherwise(c)


def totals_by_label(cart: DataFrame, quotes: DataFrame, item_multipliers: DataFrame,
                    service_multipliers: DataFrame) -> DataFrame:
    """What each quote would cost if one of its two surcharges were another of its price book's labels.

    One row per quote, kind of surcharge (``type``) and label of that kind in the quote's book: ``label_ix``, ``label``,
    ``chosen`` (it is the quote's own), ``net_total`` and ``project_total`` of the cart re-priced with that label and the quote's
    other surcharge, in cents (see ``to_cents``). Percentages are kept, as re-pricing keeps them. There are no rows of
    a kind if the other surcharge is unset or unknown, since such a quote cannot be priced; a
    quote without lines costs nothing. Two surcharges are varied one at a time, so that a quote has as many rows as its book has
    labels, not pairs of them; :func:`net_under` gives any pair.

    The cart is read once and shuffled as sums per quote. One line's share of a sum is rounded to 10^-6, so totals of
    carts with a great many lines or large multipliers differ from re-pricing by that much per line.
    """
    wanted = quotes.select("quote_id", BOOK, "item_surcharge", "service_surcharge", "n_batches")
    sums = named_multipliers(wanted, item_multipliers, service_multipliers).join(
        quote_factors(cart), "quote_id", "left").fillna(0.0, SUMS)
    labels = _labels(item_multipliers, PRICE_LIST).unionByName(_labels(service_multipliers, PROCESSING))
    of_items = F.col("type") == PRICE_LIST
    other_known = F.when(of_items, F.col("service_known")).otherwise(F.col("item_known"))
    net = F.when(of_items, net_under(F.col("multiplier"), F.col("service_mult"))).otherwise(
        net_under(F.col("item_mult"), F.col("multiplier")))
    own = F.when(of_items, F.col("item_surcharge")).otherwise(F.col("service_surcharge"))
    return sums.join(labels, BOOK).where(other_known).select(
        "quote_id", "type", "label_ix", "label", F.coalesce(own == F.col("label"), F.lit(False)).alias("chosen"),
        to_cents(net).alias("net_total"), to_cents(net * F.col("n_batches")).alias("project_total"))


def _labels(multipliers: DataFrame, type_: str) -> DataFrame:
    return multipliers.select(BOOK, F.lit(type_).alias("type"), "label_ix", "label", "multiplier")
