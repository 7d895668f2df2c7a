"""Quantity and discount edits on cart lines, one at a time or as an ordered log.

An edit is reduced to one of four kinds before it is applied:

``qty``     new quantity, the percentage stays
``pct``     new percentage, the amount follows
``amt``     new amount, the percentage follows
``remove``  the line goes
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotewright.functions.values import money
from quotewright.operators.cart import unit_price
from quotewright.operators.scans import RANGES, running
from quotewright.operators.surcharges import with_multipliers
from quotewright.operators.totals import total_text
from quotewright.schemas import BOOK, LINE_KEY

# Width of the ranges of ``seq`` in which a line's edits are replayed side by side. A line
# edited less often than this is handled in one piece.
SEQ_RANGE = 1 << 20


class Line(NamedTuple):
    """The editable part of a cart line."""

    quantity: Column
    disc_pct: Column
    disc_amt: Column
    final_total: Column


def _ordinary(c: Column) -> Column:
    """Zero or more, and neither NaN nor infinite."""
    return F.coalesce((c >= 0) & (c < F.lit(float("inf"))), F.lit(False))


def _settle(gross: Column, pct: Column, amt: Column, quantity: Column) -> Line:
    """A discount larger than the price counts as 100 %."""
    over = gross - amt < 0
    amt_kept = F.when(over, gross).otherwise(amt)
    return Line(quantity, F.when(over, 100.0).otherwise(pct), amt_kept, gross - amt_kept)


def _edited(price: Column, quantity: Column, pct: Column, kind: Column, value: Column) -> Line:
    """The line after one valid edit."""
    quantity = F.when(kind == "qty", value).otherwise(quantity)
    gross = price * quantity
    positive = F.when(gross > 0, gross)
    by_amount = kind == "amt"
    pct = (
        F.when(by_amount, F.coalesce(value / positive * 100.0, F.lit(0.0)))
        .when(kind == "pct", value).otherwise(pct)
    )
    amt = F.when(by_amount, value).otherwise(gross * (pct / 100.0))
    return _settle(gross, pct, amt, quantity)


def _editable() -> Column:
    """A line can be edited once its price is known."""
    return (F.col("unit_price").isNotNull() & F.col("quantity").isNotNull()
            & F.col("disc_pct").isNotNull())


def _apply(lines: DataFrame, columns: list[str], kind: Column, value: Column) -> DataFrame:
    """One edit, given by two columns, on every line of ``lines``; NULL ``kind``: none."""
    lines = lines.withColumns({"__kind": kind, "__value": value}).where(
        F.coalesce(F.col("__kind") != "remove", F.lit(True)))
    valid = F.col("__kind").isin("qty", "pct", "amt") & _ordinary(F.col("__value")) & _editable()
    line = _edited(F.col("unit_price"), F.col("quantity"), F.col("disc_pct"),
                   F.col("__kind"), F.col("__value"))
    new = line._asdict()
    return lines.withColumn("__valid", F.coalesce(valid, F.lit(False))).select(*[
        F.when(F.col("__valid"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in columns
    ])


def apply_edits(cart: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply at most one edit (``kind``, ``value``) per line. An edit with a negative or
    missing value changes nothing."""
    joined = cart.join(
        edits.select(*LINE_KEY, F.col("kind").alias("__k"), F.col("value").alias("__v")), LINE_KEY, "left")
    return _apply(joined, cart.columns, F.col("__k"), F.col("__v"))


def edit_quantity(cart: DataFrame, edits: DataFrame) -> DataFrame:
    """New quantities (``quote_id``, ``cart_id``, ``value``); the percentages stay."""
    return apply_edits(cart, edits.withColumn("kind", F.lit("qty")))


def edit_percent(cart: DataFrame, edits: DataFrame) -> DataFrame:
    """New percentages; the amounts follow, and more than 100 counts as 100."""
    return apply_edits(cart, edits.withColumn("kind", F.lit("pct")))


def edit_amount(cart: DataFrame, edits: DataFrame) -> DataFrame:
    """New amounts; the percentages follow, and more than the price counts as the price."""
    return apply_edits(cart, edits.withColumn("kind", F.lit("amt")))


def _to_selection(cart: DataFrame, selection: DataFrame | Column, kind: str, value: Column) -> DataFrame:
    """``selection`` is a table of line keys, or a condition on the cart, which needs no join."""
    if isinstance(selection, Column):
        return _apply(cart, cart.columns, F.when(selection, kind), value)
    chosen = selection.select(*LINE_KEY).distinct()
    return apply_edits(cart, chosen.withColumns({"kind": F.lit(kind), "value": value}))


def bulk_percent(cart: DataFrame, selection: DataFrame | Column, pct: float) -> DataFrame:
    """The same percentage on every selected line; nothing unless 0 <= pct <= 100."""
    if not 0 <= pct <= 100:
        return cart
    return _to_selection(cart, selection, "pct", F.lit(float(pct)))


def bulk_amount(cart: DataFrame, selection: DataFrame | Column, amount: float) -> DataFrame:
    """The full amount off every selected line (it is not shared out)."""
    if not amount >= 0:
        return cart
    return _to_selection(cart, selection, "amt", F.lit(float(amount)))


def discount_lookup(discounts: DataFrame) -> DataFrame:
    """Discounts by display text. A text that stands for several rows is ambiguous and
    cannot be applied; a type other than percentage and amount cannot either."""
    return discounts.groupBy(BOOK, "display_text").agg(
        F.max("amount").alias("amount"),
        F.max(F.col("type") == "percentage").alias("percentage"),
        F.max(F.col("type").isin("percentage", "amount")).alias("known"),
        (F.count("*") > 1).alias("ambiguous"))


def ambiguous_discounts(discounts: DataFrame) -> DataFrame:
    return discount_lookup(discounts).where("ambiguous").select(BOOK, "display_text")


def _usable(discounts: DataFrame) -> DataFrame:
    """(book, display_text) -> the edit that naming the discount amounts to."""
    kind = F.when(F.col("percentage"), "pct").otherwise("amt")
    value = F.when(F.col("percentage"), F.col("amount") * 100.0).otherwise(F.col("amount"))
    return discount_lookup(discounts).where(~F.col("ambiguous") & F.col("known")).select(
        BOOK, "display_text", kind.alias("kind"), value.alias("value"))


def supplier_edits(requests: DataFrame, quotes: DataFrame, discounts: DataFrame) -> DataFrame:
    """Requests that name a discount by its text -> the edit each amounts to."""
    kept = [c for c in requests.columns if c != "display_text"]
    return (
        requests.join(quotes.select("quote_id", BOOK), "quote_id")
        .join(_usable(discounts), [BOOK, "display_text"])
        .select(*kept, "kind", "value")
    )


def supplier_discount(cart: DataFrame, selection: DataFrame | Column, quotes: DataFrame,
                      discounts: DataFrame) -> DataFrame:
    """Apply to each selected line the named discount of its quote's price book.

    ``selection`` is a table (``quote_id``, ``cart_id``, ``display_text``), or an expression
    over the cart that gives each line's text, NULL where it is not selected; then the
    cart needs no second reading. The line's brand does not matter.
    """
    if isinstance(selection, Column):
        books = quotes.select("quote_id", F.col(BOOK).alias("__book"))
        usable = _usable(discounts).toDF("__book", "__text", "__k", "__v")
        named = cart.withColumn("__text", selection).join(books, "quote_id", "left")
        return _apply(named.join(usable, ["__book", "__text"], "left"), cart.columns,
                      F.col("__k"), F.col("__v"))
    return apply_edits(cart, supplier_edits(
        selection.select(*LINE_KEY, "display_text").distinct(), quotes, discounts))


def resolve_edits(edits: DataFrame, quotes: DataFrame, discounts: DataFrame) -> DataFrame:
    """An edit log in its logged form (``op``) -> valid edits (``kind``, ``value``).

    Rejected requests disappear: negative or missing values, a bulk percentage over
    100, a discount text that is unknown or ambiguous. Works on a stream as well, and reads
    the log once. Edits that name no discount get a text of their own, so that they spread
    over the tasks of the look-up, which finds nothing for them.
    """
    op, value, named = F.col("op"), F.col("value"), F.coalesce(F.col("op") == "supplier", F.lit(False))
    usable = _usable(discounts).toDF("__book", "__text", "__k", "__v").withColumn("__named", F.lit(True))
    books = quotes.select("quote_id", F.col(BOOK).alias("__book"))
    looked_up = (
        edits.withColumns({"__named": named, "__text": F.when(named, F.col("display_text")).otherwise(
            F.col("seq").cast("string"))})
        .join(books, "quote_id", "left")
        .join(usable, ["__named", "__book", "__text"], "left")
    )
    kind = (
        F.when(op.isin("qty", "pct", "amt", "remove"), op)
        .when((op == "bulk_pct") & (value <= 100), "pct")
        .when(op == "bulk_amt", "amt")
        .when(named, F.col("__k"))
    )
    amount = F.when(named, F.col("__v")).otherwise(value)
    return looked_up.select(*LINE_KEY, "seq", kind.alias("kind"), amount.alias("value")).where(
        F.col("kind").isNotNull() & ((F.col("kind") == "remove") | _ordinary(F.col("value"))))


# --- replaying a log -----------------------------------------------------------------
#
# With a fixed price, what a log leaves behind depends on few of its edits:
#   * the last quantity;
#   * the last edit that sets the discount (pct or amt), and the quantity at that time;
#   * whether any quantity above zero came later: a quantity edit never lowers the
#     percentage, but it turns a percentage that would take the line below zero into 100,
#     and whether it does so depends on the sign of the gross price alone.
# Each of these is a maximum over ``seq`` except the quantity at the time of the discount,
# which is looked up inside a piece of the log first and then across the pieces. So the
# edits of one line are spread over as many tasks as they have pieces, nothing is collected
# into lists, and the summary of a piece stands for its edits from then on.


def summarise_pieces(edits: DataFrame, seq_range: int = SEQ_RANGE) -> DataFrame:
    """One row per line and piece of valid edits, a piece being a range of ``seq``."""
    quantity = F.col("kind") == "qty"
    discount = F.col("kind").isin("pct", "amt")
    piece = [*LINE_KEY, "piece"]
    so_far = W.partitionBy(*piece).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        edits.withColumn("piece", F.floor(F.col("seq") / seq_range))
        .withColumn("qty_now", F.last(F.when(quantity, F.col("value")), ignorenulls=True).over(so_far))
        .withColumns({
            "qty_seq": F.when(quantity, F.col("seq")),
            "some_seq": F.when(quantity & (F.col("value") > 0), F.col("seq")),
            "disc_seq": F.when(discount, F.col("seq")),
            "by_amount": F.col("kind") == "amt",
        })
        .groupBy(*piece)
        .agg(
            F.max("qty_seq").alias("qty_seq"),
            F.max_by("value", "qty_seq").alias("qty"),
            F.max("some_seq").alias("some_seq"),
            F.max_by("value", "some_seq").alias("some_qty"),
            F.max("disc_seq").alias("disc_seq"),
            F.max_by("value", "disc_seq").alias("disc_value"),
            F.max_by("by_amount", "disc_seq").alias("by_amount"),
            F.max_by("qty_now", "disc_seq").alias("disc_qty"),
            F.max(F.col("kind") == "remove").alias("removed"),
        )
    )


def widen_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """Merge each line's ranges of ``seq`` into ranges ``width`` times as wide."""
    wider = pieces.withColumn("wide", F.floor(F.col("piece") / width))
    return _merged(wider, [*LINE_KEY, "wide"]).drop(
        "qty_piece", "some_piece", "disc_piece").withColumnRenamed("wide", "piece")


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """One row per line. Pieces count in order of ``piece``; ``seq`` only orders edits of
    the same piece. ``*_piece`` tells which piece a value came from."""
    return _merged(pieces, LINE_KEY)


def _merged(pieces: DataFrame, keys: list[str]) -> DataFrame:
    def place(seq: str) -> Column:
        return F.when(F.col(seq).isNotNull(), F.col("piece"))

    earlier = W.partitionBy(*keys).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    aggregates = {"removed": F.max("removed")}
    for group, columns in {"qty": ["qty_seq", "qty"], "some": ["some_seq", "some_qty"],
                           "disc": ["disc_seq", "disc_value", "by_amount", "disc_qty"]}.items():
        aggregates[f"{group}_piece"] = F.max(f"{group}_piece")
        aggregates |= {c: F.max_by(c, f"{group}_piece") for c in columns}
    return (
        pieces.withColumn("disc_qty", F.coalesce(
            "disc_qty", F.last("qty", ignorenulls=True).over(earlier)))
        .withColumns({"qty_piece": place("qty_seq"), "some_piece": place("some_seq"),
                      "disc_piece": place("disc_seq")})
        .groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    )


def condensed(merged: DataFrame) -> DataFrame:
    """``merged`` (see ``merge_pieces``) as one piece per line, to be merged with others again: of each ``seq`` only
    the order among the line's three places is kept, since between pieces it has no meaning."""
    groups = ("qty", "some", "disc")
    at = {g: F.struct(f"{g}_piece", f"{g}_seq") for g in groups}
    places = {
        f"{g}_seq": F.when(F.col(f"{g}_seq").isNotNull(), sum(
            F.when(F.col(f"{o}_seq").isNotNull() & (at[o] <= at[g]), 1).otherwise(0) for o in groups).cast("long"))
        for g in groups
    }
    return merged.withColumns(places).drop(*[f"{g}_piece" for g in groups])


def apply_summary(cart: DataFrame, summary: DataFrame, keys: Sequence[str] = LINE_KEY) -> DataFrame:
    """The cart after the edits that ``summary`` (see ``merge_pieces``) stands for, joined on ``keys``."""
    own = [c for c in summary.columns if c not in keys]
    joined = cart.join(summary.withColumnsRenamed({c: f"__{c}" for c in own}), list(keys), "left").where(
        ~F.coalesce("__removed", F.lit(False)))
    price = F.col("unit_price")
    has_qty, has_disc = F.col("__qty_seq").isNotNull(), F.col("__disc_seq").isNotNull()

    def came_after(a: str, b: str) -> Column:
        return (F.col(f"__{a}_piece") > F.col(f"__{b}_piece")) | (
            (F.col(f"__{a}_piece") == F.col(f"__{b}_piece"))
            & (F.col(f"__{a}_seq") > F.col(f"__{b}_seq")))

    # The line right after its last discount edit, or as it was if there is none.
    kind = F.when(F.col("__by_amount"), "amt").otherwise("pct")
    at_discount = _edited(price, F.coalesce("__disc_qty", "quantity"), F.col("disc_pct"),
                          kind, F.col("__disc_value"))
    state = joined.withColumns({
        "__touched": _editable() & (has_qty | has_disc),
        "__pct": F.when(has_disc, at_discount.disc_pct).otherwise(F.col("disc_pct")),
        "__amt": at_discount.disc_amt,
        "__new_qty": F.coalesce("__qty", "quantity"),
        "__ends_by_amount": F.coalesce(
            F.col("__by_amount") & (~has_qty | came_after("disc", "qty")), F.lit(False)),
        "__later": F.col("__some_seq").isNotNull() & (~has_disc | came_after("some", "disc")),
        "__later_gross": price * F.col("__some_qty"),
    })
    # A quantity that came later turns too large a percentage into 100.
    too_large = F.col("__later") & (
        F.col("__later_gross") - F.col("__later_gross") * (F.col("__pct") / 100.0) < 0)
    state = state.withColumn("__pct", F.when(too_large, 100.0).otherwise(F.col("__pct")))
    gross = price * F.col("__new_qty")
    amount = F.when(F.col("__ends_by_amount"), F.col("__amt")).otherwise(
        gross * (F.col("__pct") / 100.0))
    state = state.withColumns({"__gross": gross, "__amt": amount})
    new = {
        "quantity": F.col("__new_qty"), "disc_pct": F.col("__pct"), "disc_amt": F.col("__amt"),
        "final_total": F.col("__gross") - F.col("__amt"),
    }
    return state.select(*[
        F.when(F.col("__touched"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in cart.columns
    ])


def replay_edits(cart: DataFrame, edits: DataFrame, seq_range: int = SEQ_RANGE,
                 widths: Sequence[int] = ()) -> DataFrame:
    """The cart after all edits of a log of valid edits, applied in order of ``seq``
    (unique per line). Lines without a price keep their values but can be removed.

    A line's edits are cut into ranges of ``seq_range`` numbers, whose summaries are then
    merged. Where ``seq`` is sparse, say a timestamp, a busy line has many ranges: ``widths``
    merges them in steps, e.g. ``(1 << 20,)`` for up to a million neighbours at a time.
    """
    pieces = summarise_pieces(edits, seq_range)
    for width in widths:
        pieces = widen_pieces(pieces, width)
    return apply_summary(cart, merge_pieces(pieces))


def dated_params(edits: DataFrame, changes: DataFrame, quotes: DataFrame, item_multipliers: DataFrame,
                 service_multipliers: DataFrame, store: Callable[[DataFrame], DataFrame],
                 ranges: Sequence[int] = RANGES) -> tuple[DataFrame, DataFrame]:
    """The edits with ``params``, the multipliers of the quote's last change before them (NULL: none), and the
    changes that count: those to surcharges that are set and known."""
    books = quotes.select("quote_id", BOOK)
    counted = store(with_multipliers(
        changes.select("quote_id", "seq", "item_surcharge", "service_surcharge").join(books, "quote_id"),
        item_multipliers, service_multipliers,
    ).where("priceable").select("quote_id", "seq", F.struct("item_mult", "service_mult").alias("params")))
    both = edits.select(*LINE_KEY, "seq", "kind", "value").unionByName(
        counted.select("quote_id", "seq", F.col("params").alias("__params")), allowMissingColumns=True)
    # A change has no kind and comes after an edit of the same number.
    both = store(both.withColumn("__change", F.col("__params").isNotNull()))
    dated = running(both, ["quote_id"], "seq", last={"params": F.col("__params")}, tie=["__change"], ranges=ranges)
    return dated.where("not __change").drop("__change", "__params", "params_before"), counted


def replay_with_surcharges(cart: DataFrame, edits: DataFrame, changes: DataFrame, quotes: DataFrame,
                           item_multipliers: DataFrame, service_multipliers: DataFrame,
                           store: Callable[[DataFrame], DataFrame], ranges: Sequence[int] = RANGES) -> DataFrame:
    """The cart after a log of valid edits during which quotes change their surcharges.

    ``changes`` has ``quote_id``, ``seq`` (unique per quote), ``item_surcharge`` and ``service_surcharge``; a change
    re-prices all lines of its quote at that point, which undoes clamps and rescales amounts, and
    comes after an edit of the same ``seq``. A change to unset or unknown surcharges leaves the lines
    as they are. Edits of a line do nothing while its price is unknown.

    Quantity and percentage are set by edits alone, at the price then in force: by the last quantity,
    the last discount with the quantity and price at its time, and the last later quantity that made the gross price
    positive, or negative, which may turn the percentage into 100. All of these are maxima over ``seq``, so the log is
    summarised in one pass, however often prices changed. A re-pricing follows from the final state. ``store`` writes a
    table and reads it again; it is called a fixed number of times.
    """
    lines = store(cart)
    dated, counted = dated_params(edits, changes, quotes, item_multipliers, service_multipliers, store, ranges)
    known = lines.select(*LINE_KEY, "type", "base_ref", "add_ref", "is_constant", "unit_price", "quantity", "disc_pct")
    price = F.when(F.col("params").isNull(), F.col("unit_price")).otherwise(
        unit_price(F.col("params.item_mult"), F.col("params.service_mult")))
    priced = dated.join(known, LINE_KEY).withColumn("price", price)
    valid = F.col("price").isNotNull() & F.col("quantity").isNotNull() & F.col("disc_pct").isNotNull()
    priced = store(priced.select(
        *LINE_KEY, "seq", "value", "price", F.col("quantity").alias("first_quantity"),
        F.when((F.col("kind") == "remove") | valid, F.col("kind")).alias("kind")).where("kind IS NOT NULL"))
    is_qty, is_discount = F.col("kind") == "qty", F.col("kind").isin("pct", "amt")
    placed = running(priced, LINE_KEY, "seq", last={"qty": F.when(is_qty, F.col("value"))}, ranges=ranges)
    gross = F.col("price") * F.col("value")

    def latest(value: Column, when: Column) -> Column:
        return F.max_by(F.struct(value.alias("value"), "seq"), F.when(when, F.col("seq")))

    discount = F.struct("kind", "value", "price", F.coalesce("qty", "first_quantity").alias("quantity"))
    summary = placed.groupBy(*LINE_KEY).agg(
        F.max(F.col("kind") == "remove").alias("__removed"),
        F.max(F.when(is_qty | is_discount, F.col("seq"))).alias("__last"),
        latest(F.col("value"), is_qty).alias("__qty"), latest(discount, is_discount).alias("__disc"),
        latest(gross, is_qty & (gross > 0)).alias("__above"), latest(gross, is_qty & (gross < 0)).alias("__below"))
    final = counted.groupBy("quote_id").agg(
        F.max("seq").alias("__changed"), F.max_by("params", "seq").alias("__params"))
    joined = lines.join(summary, LINE_KEY, "left").join(final, "quote_id", "left").where(
        ~F.coalesce("__removed", F.lit(False)))
    d = F.col("__disc.value")
    at_discount = _edited(d["price"], d["quantity"], F.col("disc_pct"), d["kind"], d["value"])
    has_discount, edited, changed = F.col("__disc").isNotNull(), F.col("__last").isNotNull(), F.col("__changed").isNotNull()
    repriced = changed & (~edited | (F.col("__changed") >= F.col("__last")))

    def too_large(later: str) -> Column:
        """Whether a quantity that came after the discount turns its percentage into 100."""
        after = F.col(later).isNotNull() & (~has_discount | (F.col(f"{later}.seq") > F.col("__disc.seq")))
        g = F.col(f"{later}.value")
        return F.coalesce(after & (g - g * (F.col("__pct") / 100.0) < 0), F.lit(False))

    state = joined.withColumn("__pct", F.when(has_discount, at_discount.disc_pct).otherwise(F.col("disc_pct")))
    state = state.withColumns({
        "__pct": F.when(too_large("__above") | too_large("__below"), 100.0).otherwise(F.col("__pct")),
        "__price": F.when(changed, unit_price(F.col("__params.item_mult"), F.col("__params.service_mult"))).otherwise(
            F.col("unit_price")),
        "__quantity": F.coalesce("__qty.value", "quantity"),
        "__by_amount": ~repriced & F.coalesce((d["kind"] == "amt") & (F.col("__disc.seq") == F.col("__last")), F.lit(False)),
        "__at_discount": at_discount.disc_amt, "__touched": edited | changed,
    })
    gross = F.col("__price") * F.col("__quantity")
    state = state.withColumns({"__gross": gross, "__amt": F.when(F.col("__by_amount"), F.col("__at_discount")).otherwise(
        gross * (F.col("__pct") / 100.0))})
    new = {"unit_price": F.col("__price"), "quantity": F.col("__quantity"), "disc_pct": F.col("__pct"),
           "disc_amt": F.col("__amt"), "final_total": F.col("__gross") - F.col("__amt")}
    return state.select(*[
        F.when(F.col("__touched"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cart.columns])


# --- totals after every event -----------------------------------------------------------


class _State(NamedTuple):
    """What the edits of a line up to some event come to: running values of ``running``."""

    qty: Column  # struct seq, value: the last quantity
    disc: Column  # struct seq, kind, value, quantity: the last discount
    some: Column  # struct seq, gross: the last quantity above zero


def _total_in(state: _State) -> Column:
    """The line's total in a state of its log; the line's own columns are those before the log."""
    price = F.col("unit_price")
    at_discount = _edited(price, state.disc["quantity"], F.col("disc_pct"), state.disc["kind"], state.disc["value"])
    pct = F.when(state.disc.isNotNull(), at_discount.disc_pct).otherwise(F.col("disc_pct"))
    later = state.some.isNotNull() & (state.disc.isNull() | (state.some["seq"] > state.disc["seq"]))
    some = state.some["gross"]
    pct = F.when(later & (some - some * (pct / 100.0) < 0), 100.0).otherwise(pct)
    gross = price * F.coalesce(state.qty["value"], F.col("quantity"))
    by_amount = (state.disc["kind"] == "amt") & (state.qty.isNull() | (state.disc["seq"] > state.qty["seq"]))
    amount = F.when(F.coalesce(by_amount, F.lit(False)), at_discount.disc_amt).otherwise(gross * (pct / 100.0))
    untouched = state.qty.isNull() & state.disc.isNull()
    return F.when(untouched, F.col("final_total")).otherwise(gross - amount)


def totals_after_events(cart: DataFrame, edits: DataFrame, quotes: DataFrame, store: Callable[[DataFrame], DataFrame],
                        ranges: Sequence[int] = RANGES) -> DataFrame:
    """One row per valid edit of a quote in ``quotes``: what the quote comes to right after it.

    ``quote_id``, ``seq`` and ``cart_id`` of the edit, then ``n_lines``, ``net_total``, ``n_batches``, ``project_total`` and
    ``text``, the grand total as printed (see ``totals.grand_total_text``). Edits of lines that are unknown, have
    no price or are gone change nothing. Edits of a quote with the same ``seq`` are taken by ``cart_id``.

    Each event's effect on its line's total follows from the running state of the line before and after it; the
    quote's totals are running sums of the effects. Both scans are cut into ranges of ``seq``.
    """
    lines = store(cart.select(*LINE_KEY, "unit_price", "quantity", "disc_pct", "final_total"))
    log = edits.select(*LINE_KEY, "seq", "kind", "value").join(quotes.select("quote_id"), "quote_id", "left_semi")
    events = store(log.join(lines.withColumn("known", F.lit(True)), LINE_KEY, "left"))
    is_qty, is_discount = _editable() & (F.col("kind") == "qty"), _editable() & F.col("kind").isin("pct", "amt")
    seq, value = F.col("seq"), F.col("value")
    once = store(running(events, LINE_KEY, "seq", last={
        "qty": F.when(is_qty, F.struct("seq", "value")),
        "gone": F.when(F.col("kind") == "remove", F.lit(True))}, ranges=ranges))
    quantity = F.coalesce("qty.value", "quantity")
    twice = running(once, LINE_KEY, "seq", last={
        "disc": F.when(is_discount, F.struct("seq", "kind", "value", quantity.alias("quantity"))),
        "some": F.when(is_qty & (value > 0), F.struct(seq, (F.col("unit_price") * value).alias("gross")))}, ranges=ranges)
    after, before = (money(_total_in(_State(*[F.col(f"{c}{end}") for c in _State._fields]))) for end in ("", "_before"))
    counts = F.coalesce("known", F.lit(False)) & F.col("gone_before").isNull()
    leaves = F.col("kind") == "remove"
    effects = store(twice.select(
        *LINE_KEY, "seq",
        F.when(counts, F.when(leaves, F.lit(0)).otherwise(after) - before).otherwise(0).cast("decimal(28,6)").alias("delta"),
        F.when(counts & leaves, -1).otherwise(0).alias("fewer")))
    summed = running(effects, ["quote_id"], "seq", sums={"changed": F.col("delta"), "lines": F.col("fewer")},
                     tie=["cart_id"], ranges=ranges)
    first = lines.groupBy("quote_id").agg(F.sum(money(F.col("final_total"))).alias("first"), F.count("*").alias("n_first"))
    kept = ["n_batches", "item_surcharge", "service_surcharge"]
    totals = summed.join(first, "quote_id", "left").join(quotes.select("quote_id", *kept), "quote_id").withColumns({
        "n_lines": F.coalesce("n_first", F.lit(0)) + F.col("lines"),
        "net_total": (F.coalesce("first", F.lit(0)) + F.col("changed")).cast("double")})
    return totals.select(
        "quote_id", "seq", "cart_id", "n_lines", "net_total", "n_batches",
        (F.col("net_total") * F.col("n_batches")).alias("project_total"), total_text().alias("text"))
