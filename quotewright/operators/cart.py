"""Building and repricing carts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.operators.joins import null_safe_join
from quotewright.operators.surcharges import with_multipliers
from quotewright.schemas import CART, ITEM_LINE, LINE_KEY, SERVICE_CODE, SERVICE_LINE


def _new_lines(picks: DataFrame, prefix: str, columns: dict[str, Column]) -> DataFrame:
    """Fresh cart lines from picked catalog rows. ``add_seq`` numbers the add action and
    ``pick_ix`` the row within it; together they make the line's id."""
    values = {
        "quote_id": F.col("quote_id"),
        "cart_id": F.concat_ws("-", F.lit(prefix), "add_seq", "pick_ix"),
        **columns,
        "unit_price": F.lit(0.0), "quantity": F.lit(1.0), "disc_pct": F.lit(0.0),
        "disc_amt": F.lit(0.0), "final_total": F.lit(0.0),
    }
    return picks.select(*[values[f.name].cast(f.dataType).alias(f.name)
                          if f.name != "quote_id" else values[f.name]
                          for f in CART.fields])


def new_item_lines(picks: DataFrame) -> DataFrame:
    return _new_lines(picks, "I", {
        "product_code": F.col("product_code"), "name": F.col("item"),
        "description": F.col("description"), "type": F.lit(ITEM_LINE),
        "category": F.col("category"), "base_ref": F.col("base_cost"),
        "add_ref": F.col("add_cost"), "is_constant": F.col("is_constant"),
    })


def new_service_lines(picks: DataFrame) -> DataFrame:
    return _new_lines(picks, "P", {
        "product_code": F.lit(SERVICE_CODE), "name": F.col("service"),
        "description": F.col("description"), "type": F.lit(SERVICE_LINE),
        "category": F.col("grp"), "base_ref": F.col("base_price"),
        "add_ref": F.lit(0.0), "is_constant": F.lit(False),
    })


def add_items(cart: DataFrame, picks: DataFrame) -> DataFrame:
    """Append picked items whose product code the quote does not have yet. The check is
    against the cart as it was, so repeats inside one pick list are all added."""
    fresh = null_safe_join(picks, cart.select("quote_id", "product_code"),
                           ["quote_id", "product_code"], "left_anti")
    return cart.unionByName(new_item_lines(fresh))


def add_services(cart: DataFrame, picks: DataFrame) -> DataFrame:
    """Append picked services whose name is not the name of any line of the quote."""
    present = cart.select("quote_id", F.col("name").alias("service"))
    fresh = null_safe_join(picks, present, ["quote_id", "service"], "left_anti")
    return cart.unionByName(new_service_lines(fresh))


def remove_lines(cart: DataFrame, removals: DataFrame | Column) -> DataFrame:
    """The cart without the lines in ``removals``: a table of line keys, or a condition."""
    if isinstance(removals, Column):
        return cart.where(~F.coalesce(removals, F.lit(False)))
    return cart.join(removals.select(*LINE_KEY), LINE_KEY, "left_anti")


def unit_price(item_mult: Column, service_mult: Column) -> Column:
    item = F.col("type") == ITEM_LINE
    return (
        F.when(item & F.col("is_constant"), F.col("base_ref") + F.col("add_ref"))
        .when(item & ~F.col("is_constant"), F.col("base_ref") * item_mult + F.col("add_ref"))
        .when(F.col("type") == SERVICE_LINE, F.col("base_ref") * service_mult)
        .otherwise(F.lit(0.0))
    )


def pricing_params(quotes: DataFrame, item_multipliers: DataFrame, service_multipliers: DataFrame) -> DataFrame:
    """``quote_id`` and both multipliers of quotes that can be priced."""
    return with_multipliers(
        quotes.select("quote_id", "book_id", "item_surcharge", "service_surcharge"),
        item_multipliers, service_multipliers,
    ).where("priceable").select("quote_id", "item_mult", "service_mult", "priceable")


def reprice(cart: DataFrame, quotes: DataFrame, item_multipliers: DataFrame,
            service_multipliers: DataFrame) -> DataFrame:
    """Price every line under its quote's surcharges, keeping the discount percentage.
    Lines of a quote that is not priceable stay as they are."""
    return price_with(cart, pricing_params(quotes, item_multipliers, service_multipliers), ["quote_id"])


def price_with(cart: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """``reprice`` with the ``pricing_params`` that lines find by ``keys``."""
    priced = (
        cart.join(params, keys, "left")
        .withColumn("__price", unit_price(F.col("item_mult"), F.col("service_mult")))
        .withColumn("__gross", F.col("__price") * F.col("quantity"))
        .withColumn("__amt", F.col("__gross") * (F.col("disc_pct") / 100.0))
    )
    new = {
        "unit_price": F.col("__price"),
        "disc_amt": F.col("__amt"),
        "final_total": F.col("__gross") - F.col("__amt"),
    }
    return priced.select(*[
        F.when(F.col("priceable"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in cart.columns
    ])
