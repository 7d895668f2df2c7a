"""Replaying an ordered log of additions and removals of cart lines.

Whether an addition counts depends on the cart as it then is. Of one quote and product code, the lines
added by one request come and go like one group: it is there from its request to the removal of its
last line, and while it is there no other request with the code counts. So after a group that counted, the
next to count is the first request from its end on; each group points to that one, whether or not it counts
itself, and the groups that count are those reached from the first. Reaching doubles the pointers, so a
chain of n groups takes log2(n) rounds, whatever part of the log one code has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.operators.cart import new_item_lines, new_service_lines
from quotewright.operators.scans import RANGES, running
from quotewright.schemas import CART, LINE_KEY

FIRST = -1  # when the lines of the cart before the log were added
Store = Callable[[DataFrame], DataFrame]


def _key(value: Column) -> Column:
    """A key that is never NULL; NULL is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def _with_ends(lines: DataFrame, removals: DataFrame) -> DataFrame:
    """``lines`` (with ``start``) with ``end``, the first removal after the start, NULL if there is none."""
    first = (
        lines.select(*LINE_KEY, "start").join(removals.select(*LINE_KEY, F.col("seq").alias("end")), LINE_KEY)
        .where("end > start").groupBy(*LINE_KEY, "start").agg(F.min("end").alias("end")))
    return lines.join(first, [*LINE_KEY, "start"], "left")


def _groups(lines: DataFrame) -> DataFrame:
    """Lines of one quote, key and request as one group; it ends with its last line."""
    return lines.groupBy("quote_id", "key", "start").agg(
        F.when(F.count("end") == F.count("*"), F.max("end")).alias("end"))


def _counting(groups: DataFrame, store: Store, ranges: Sequence[int]) -> DataFrame:
    """The groups (quote_id, key, start) that count; of a quote and key the first does."""
    # Seen from late to early, the request last met by an end is the first one from it on.
    probes = groups.where("end IS NOT NULL").select("quote_id", "key", (-F.col("end")).alias("at"), "start", F.lit(True).alias("probe"))
    requests = groups.select("quote_id", "key", (-F.col("start")).alias("at"), "start", F.lit(False).alias("probe"))
    seen = running(store(requests.unionByName(probes)), ["quote_id", "key"], "at",
                   last={"next": F.when(~F.col("probe"), F.col("start"))}, tie=["probe"], ranges=ranges)
    follows = store(seen.where("probe AND next IS NOT NULL").select("quote_id", "key", "start", "next"))
    reached = [groups.groupBy("quote_id", "key").agg(F.min("start").alias("start"))]
    while True:
        everything = reached[0]
        for part in reached[1:]:
            everything = everything.unionByName(part)
        new = store(everything.join(follows, ["quote_id", "key", "start"]).select("quote_id", "key", F.col("next").alias("start")))
        if new.isEmpty():
            return everything
        reached.append(new)
        further = follows.select("quote_id", "key", F.col("start").alias("next"), F.col("next").alias("after"))
        follows = store(follows.join(further, ["quote_id", "key", "next"]).select("quote_id", "key", "start", F.col("after").alias("next")))


def _accepted(lines: DataFrame, store: Store, ranges: Sequence[int]) -> DataFrame:
    """The lines whose group counts."""
    return lines.join(_counting(store(_groups(lines)), store, ranges), ["quote_id", "key", "start"], "left_semi")


def _blocked_by(lines: DataFrame, wanted: DataFrame, store: Store, ranges: Sequence[int]) -> DataFrame:
    """Requests of ``wanted`` (quote_id, key, start) at which a line with their key is in the cart."""
    endless = F.lit((1 << 63) - 1)
    there = lines.select("quote_id", "key", F.col("start").alias("at"), F.coalesce("end", endless).alias("until"), F.lit(False).alias("probe"))
    asked = wanted.select("quote_id", "key", F.col("start").alias("at"), F.lit(None).cast("long").alias("until"), F.lit(True).alias("probe"))
    seen = running(store(there.unionByName(asked.distinct())), ["quote_id", "key"], "at",
                   most={"latest": F.col("until")}, tie=["probe"], ranges=ranges)
    return seen.where("probe AND latest > at").select("quote_id", "key", F.col("at").alias("start"))


def replay_cart_log(cart: DataFrame, item_picks: DataFrame, service_picks: DataFrame, removals: DataFrame,
                    store: Store, ranges: Sequence[int] = RANGES) -> DataFrame:
    """The cart after a log of requests, each taken in order of its number.

    ``item_picks`` and ``service_picks`` are as for ``add_items`` and ``add_services``, with ``add_seq`` (0 or more) as the
    request's number; ``removals`` has ``quote_id``, ``cart_id`` and ``seq``. A request adds the picked items
    whose product code, or services whose name, no line of the quote has at that time; repeats inside a
    request are all added; NULL equals NULL. A removal frees the code, or name, again once its last line is gone; one of a
    line that is not there does nothing. Of equal numbers removals come first, then items, then services. Names of
    items block services; an item whose code is that of services is checked against items and
    the services of the cart before the log. New lines have no price yet.

    ``store`` writes a table and reads it again; it is called a number of times that grows with the logarithm of
    the longest alternation of one code.
    """
    before = store(_with_ends(cart.withColumn("start", F.lit(FIRST).cast("long")), removals))
    added = {}
    for kind, picks, build in (("items", item_picks, new_item_lines), ("services", service_picks, new_service_lines)):
        # New lines keep their request's number beside the columns of a cart line.
        lines = build(picks).withColumn("start", F.split_part("cart_id", F.lit("-"), F.lit(2)).cast("long"))
        added[kind] = store(_with_ends(lines, removals))
    span = ["quote_id", "key", "start", "end", "cart_id"]

    def spans(lines: DataFrame, column: str) -> DataFrame:
        return lines.withColumn("key", _key(F.col(column))).select(*span)

    def rivals(lines: DataFrame, column: str, asked: DataFrame) -> DataFrame:
        """The few of ``lines`` that have a key which a request asks for."""
        return spans(lines, column).join(asked.select("quote_id", "key").distinct(), ["quote_id", "key"], "left_semi")

    asked = spans(added["items"], "product_code")
    items = store(_accepted(asked.unionByName(rivals(before, "product_code", asked)), store, ranges).where(F.col("start") != FIRST))
    own = added["items"].join(items.select(*LINE_KEY).distinct(), LINE_KEY, "left_semi")
    asked = spans(added["services"], "name")
    named = rivals(before.where("type = 'Item'"), "name", asked).unionByName(rivals(own, "name", asked))
    free = asked.join(_blocked_by(named, asked, store, ranges), ["quote_id", "key", "start"], "left_anti")
    services = store(_accepted(
        free.unionByName(rivals(before.where("type <> 'Item'"), "name", asked)), store, ranges).where(F.col("start") != FIRST))
    kept = before.where("end IS NULL")
    for new, which in ((own, items), (added["services"], services)):
        kept = kept.unionByName(new.where("end IS NULL").join(which.select(*LINE_KEY).distinct(), LINE_KEY, "left_semi"))
    return kept.select(*CART.fieldNames())
