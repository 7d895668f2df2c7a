"""Carts stored by quote, so that pricing, edits and totals move no line.

Lines are bucketed by quote and part. Most quotes have one part; one with many lines has more, to which its lines are
dealt by the hash of their ``cart_id``, so a quote that owns a third of all lines fills many buckets. What meets the lines
is small, a row per quote and part or one per edited line, and goes to the buckets.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quotewright.operators.cart import price_with, pricing_params
from quotewright.operators.discounts import apply_summary, merge_pieces, summarise_pieces
from quotewright.schemas import LINE_KEY

PART = "quote_part"
BY_QUOTE = ["quote_id", PART]
# Lines of a quote that stay together, and of a bucket on average.
PART_LINES = 1 << 20


class StoredCart(NamedTuple):
    """``lines`` is the cart with ``quote_part``; ``parts`` has ``quote_id`` and ``n_parts`` of quotes with several."""

    lines: DataFrame
    parts: DataFrame


def _dealt(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows per line with the part that the line is in."""
    spread = F.pmod(F.xxhash64("cart_id"), F.col("n_parts")).cast("int")
    joined = lines.join(parts.select(F.col("quote_id").alias("__quote"), "n_parts"),
                        F.col("quote_id").eqNullSafe(F.col("__quote")), "left")
    return joined.withColumn(PART, F.coalesce(spread, F.lit(0))).drop("__quote", "n_parts")


def store_cart(cart: DataFrame, folder: str, part_lines: int = PART_LINES, buckets: int | None = None) -> StoredCart:
    """Write ``cart`` to the new folder ``folder``, which all executors reach.

    A quote with more than ``part_lines`` lines has several parts; lines without a quote count as one quote. There
    are as many ``buckets`` as make ``part_lines`` lines each, but no fewer than shuffle partitions, below which Spark
    would deal the lines anew. The columns ``quote_part`` and ``n_parts`` are the table's own and refused in ``cart``.
    """
    spark = cart.sparkSession
    taken = {PART, "n_parts", "__quote"} & set(cart.columns)
    if taken:
        raise ValueError(f"a stored cart cannot have columns {sorted(taken)}")
    sizes = cart.groupBy("quote_id").agg(F.count("*").alias("n"))
    if buckets is None:
        buckets = buckets_for(spark, cart.count(), part_lines)
    return _write(_deal(cart, sizes, folder, part_lines, buckets), folder, buckets)


def store_priced(cart: DataFrame, quotes: DataFrame, item_multipliers: DataFrame, service_multipliers: DataFrame, folder: str,
                 sizes: DataFrame, buckets: int, columns: list[str] | None = None, part_lines: int = PART_LINES) -> StoredCart:
    """``cart`` re-priced and written as ``store_cart`` does, with one shuffle for both.

    ``sizes`` (``quote_id``, ``n``) gives at least the number of each quote's lines, so that the cart is computed once; only
    its line keys and ``columns`` are stored, all if there are none.
    """
    dealt = _deal(cart, sizes, folder, part_lines, buckets)
    parts = cart.sparkSession.read.parquet(f"{folder}/parts")
    priced = price_with(dealt, _params(quotes, item_multipliers, service_multipliers, parts), BY_QUOTE)
    return _write(priced.select(*LINE_KEY, PART, *columns) if columns else priced, folder, buckets)


def buckets_for(spark: SparkSession, lines: int, part_lines: int = PART_LINES) -> int:
    """``part_lines`` lines in a bucket on average, but no fewer buckets than shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines / part_lines))


def _deal(cart: DataFrame, sizes: DataFrame, folder: str, part_lines: int, buckets: int) -> DataFrame:
    """Store the parts of large quotes, and deal the lines to their buckets."""
    sizes.where(F.col("n") > part_lines).select(
        "quote_id", F.ceil(F.col("n") / part_lines).cast("long").alias("n_parts"),
    ).write.mode("overwrite").parquet(f"{folder}/parts")
    # Dealt by the buckets' own hash, each task writes one bucket.
    return _dealt(cart, cart.sparkSession.read.parquet(f"{folder}/parts")).repartition(buckets, *BY_QUOTE)


def _write(dealt: DataFrame, folder: str, buckets: int) -> StoredCart:
    spark = dealt.sparkSession
    (dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *BY_QUOTE)
     .option("path", f"{folder}/lines").saveAsTable(f"cart_{uuid.uuid4().hex}"))
    # Written last: a cart without it is not whole.
    spark.range(buckets, buckets + 1, 1, 1).select(F.col("id").alias("buckets"), F.lit(dealt.schema.json()).alias("columns")).write.mode(
        "overwrite").parquet(f"{folder}/table")
    return load_cart(spark, folder)


def load_cart(spark: SparkSession, folder: str) -> StoredCart:
    """A cart that ``store_cart`` has written, also by another session: the folder tells all."""
    try:
        buckets, fields = spark.read.schema("buckets long, columns string").parquet(f"{folder}/table").first()
    except (AnalysisException, TypeError):  # no such folder, or no row in it yet
        raise ValueError(f"{folder} holds no whole cart") from None
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(fields)))
    name = f"cart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(BY_QUOTE)}) "
              f"INTO {buckets} BUCKETS LOCATION '{folder}/lines'")
    return StoredCart(spark.table(name), spark.read.parquet(f"{folder}/parts"))


def reprice_stored(cart: StoredCart, quotes: DataFrame, item_multipliers: DataFrame,
                   service_multipliers: DataFrame) -> StoredCart:
    """``reprice`` of a stored cart: a row per quote and part goes to the lines."""
    params = _params(quotes, item_multipliers, service_multipliers, cart.parts)
    return cart._replace(lines=price_with(cart.lines, params, BY_QUOTE))


def _params(quotes: DataFrame, item_multipliers: DataFrame, service_multipliers: DataFrame, parts: DataFrame) -> DataFrame:
    """``pricing_params`` per quote and part."""
    params = pricing_params(quotes, item_multipliers, service_multipliers).join(parts, "quote_id", "left")
    part = F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)).cast("int") - 1))
    return params.withColumn(PART, part).drop("n_parts")


def with_lines(summary: DataFrame, cart: StoredCart | DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a line key, and the ``columns`` of their line; those without a line go. A stored cart's lines stay where they are."""
    if not isinstance(cart, StoredCart):
        return summary.join(cart.select(*LINE_KEY, *columns), LINE_KEY)
    # Between equal numbers of partitions the left side is the one that stays.
    lines = cart.lines.select(*LINE_KEY, PART, *columns)
    found = lines.join(_dealt(summary, cart.parts), [*LINE_KEY, PART])
    return found.select(*summary.columns, *columns)


def replay_stored(cart: StoredCart, edits: DataFrame) -> StoredCart:
    """``replay_edits`` of a stored cart: a summary per edited line goes to the lines."""
    summary = _dealt(merge_pieces(summarise_pieces(edits)), cart.parts)
    return cart._replace(lines=apply_summary(cart.lines, summary, [*LINE_KEY, PART]))
