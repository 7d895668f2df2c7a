"""Quote totals that follow a stream of edits.

Each micro-batch takes the old amounts of the lines it edits out of their quotes' totals and adds the new ones. What
a line was before a batch follows from the summaries of its earlier edits, kept as a Fenwick tree of micro-batches: node
n stands for the last lowbit(n) batches up to n, so any first n batches are at most log2(n) + 1 nodes. The changes of the totals are kept
likewise, and can be read as they were after any batch. There is no state store, and no Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotewright.functions.values import money
from quotewright.operators.discounts import apply_summary, condensed, merge_pieces, summarise_pieces
from quotewright.operators.totals import project_totals
from quotewright.schemas import LINE_KEY
from quotewright.sources.carts import StoredCart, with_lines
from quotewright.sources.marks import is_done, last_done, mark_done
from quotewright.streaming.nodes import inner as _inner
from quotewright.streaming.nodes import nodes as _nodes

AMOUNTS = ["unit_price", "quantity", "disc_pct", "disc_amt", "final_total"]
SUMS = ["raw_total", "discount_total", "net_total"]


def _pieces(spark: SparkSession, out: str, nodes: Iterable[int]) -> list[DataFrame]:
    """Summaries of the nodes' batches; an odd node is its batch."""
    return [spark.read.parquet(f"{out}/{'nodes' if n % 2 == 0 else 'edits'}/{n}").drop(*AMOUNTS)
            .withColumn("piece", F.lit(n).cast("long")) for n in nodes]


def _union(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def _sums(lines: DataFrame, sign: int) -> DataFrame:
    def signed(c: Column) -> Column:
        return (money(c) * sign).cast("decimal(38,6)")

    return lines.select(
        "quote_id", signed(F.col("unit_price") * F.col("quantity")).alias("raw_total"),
        signed(F.col("disc_amt")).alias("discount_total"), signed(F.col("final_total")).alias("net_total"),
        F.lit(sign).cast("long").alias("n_lines"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("quote_id").agg(
        *[F.sum(c).cast("decimal(38,6)").alias(c) for c in SUMS], F.sum("n_lines").alias("n_lines"))


def begin_totals(cart: DataFrame | StoredCart, out: str) -> None:
    """Store the totals of the priced ``cart`` in the new folder ``out``, before any edit."""
    lines = cart.lines if isinstance(cart, StoredCart) else cart
    _added(_sums(lines, 1)).write.mode("overwrite").parquet(f"{out}/totals/0")
    mark_done(lines.sparkSession, out, 0)


def update_totals(batch: DataFrame, batch_id: int, cart: DataFrame | StoredCart, out: str) -> None:
    """Bring the totals in ``out`` up to date with one micro-batch of valid edits.

    Everything about a batch is written to folders of its own, from earlier batches alone, and the mark that it is
    done comes last. So a batch that is run again after a loss replaces what it had begun, and one that
    was done is left as it is: readers never see it go. Edits of lines that ``cart`` lacks change nothing.
    """
    spark, n = batch.sparkSession, batch_id + 1
    if is_done(spark, out, n):
        return
    if not is_done(spark, out, n - 1):
        raise ValueError(f"batch {n - 1} is not stored in {out}; call begin_totals before the first one")
    edits = merge_pieces(summarise_pieces(batch)).drop("qty_piece", "some_piece", "disc_piece")
    with_lines(edits, cart, AMOUNTS).write.mode("overwrite").parquet(f"{out}/edits/{n}")
    edited = spark.read.parquet(f"{out}/edits/{n}")
    lines = edited.select(*LINE_KEY, *AMOUNTS)
    own = edited.drop(*AMOUNTS).withColumn("piece", F.lit(n).cast("long"))
    keys = lines.select(*LINE_KEY)
    earlier = [p.join(keys, LINE_KEY, "left_semi") for p in _pieces(spark, out, _nodes(n - 1))]
    before = apply_summary(lines, merge_pieces(_union(earlier[0], earlier[1:]))) if earlier else lines
    after = apply_summary(lines, merge_pieces(_union(own, earlier)))
    changes = _union(_sums(before, -1), [_sums(after, 1)])
    inner = list(_inner(n))
    _added(_union(changes, [_totals(spark, out, m) for m in inner])).write.mode("overwrite").parquet(f"{out}/totals/{n}")
    if n % 2 == 0:
        node = condensed(merge_pieces(_union(own, _pieces(spark, out, inner))))
        node.write.mode("overwrite").parquet(f"{out}/nodes/{n}")
    mark_done(spark, out, n)


def stream_totals(edits: DataFrame, cart: DataFrame | StoredCart, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps the totals in ``out`` up to date with a stream of valid edits.

    ``cart`` is the priced cart that ``begin_totals`` was given, stored: each micro-batch reads it once, and does not
    shuffle it if it is stored by quote (``store_priced``). Within a micro-batch edits apply in order of ``seq``, between
    micro-batches in order of arrival. Without a ``trigger`` all that has arrived is taken, in one micro-batch or those
    that the source's limits cut.
    """
    return (
        edits.writeStream.foreachBatch(lambda batch, batch_id: update_totals(batch, batch_id, cart, out))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _totals(spark: SparkSession, out: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{out}/totals/{n}")


def followed_totals(quotes: DataFrame, out: str, upto: int | None = None) -> DataFrame:
    """Totals of every quote as ``quote_totals`` gives them, after all micro-batches or the first ``upto``.

    Neither the cart nor the edits are read, but one table of sums per node. Amounts of 10^21 or more count as
    nothing here, since they could not be taken out again exactly.
    """
    spark = quotes.sparkSession
    n = last_done(spark, out) if upto is None else upto
    sums = _added(_union(_totals(spark, out, 0), [_totals(spark, out, m) for m in _nodes(n)]))
    return project_totals(sums.withColumns({c: F.col(c).cast("double") for c in SUMS}), quotes)
