"""Versions of the lines that a stream edits, without Python and without a state store.

What later edits of a line need of earlier ones is its last version, a row of fixed size. A micro-batch is reduced to one
summary per line, looks up the versions of its lines, and writes new ones. Versions are kept as a Fenwick tree of
micro-batches, of which each node holds the latest version of every line that its batches edit. So a look-up reads at most log2(n) + 1
nodes, whatever the length of the log, and no edit is read twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotewright.operators.discounts import apply_summary, merge_pieces, summarise_pieces
from quotewright.schemas import LINE_KEY
from quotewright.sources.marks import is_done, last_done, mark_done
from quotewright.streaming.edits import AMOUNTS, current_lines
from quotewright.streaming.nodes import inner, nodes

FIELDS = [*AMOUNTS[1:], "removed"]


def _versions(spark: SparkSession, out: str, wanted: Iterable[int]) -> list[DataFrame]:
    """Versions in the nodes' batches; an odd node is its batch."""
    return [spark.read.parquet(f"{out}/{'nodes' if n % 2 == 0 else 'versions'}/{n}") for n in wanted]


def _latest(parts: list[DataFrame]) -> DataFrame:
    """One row per line. The columns are taken one by one, so that they are combined by hashing before the shuffle."""
    return reduce(DataFrame.unionByName, parts).groupBy(*LINE_KEY).agg(
        *[F.max_by(c, "version").alias(c) for c in FIELDS], F.max("version").alias("version"))


def update_versions(batch: DataFrame, batch_id: int, cart: DataFrame, out: str) -> None:
    """Store the versions that the lines of ``cart`` have after one micro-batch of valid edits, in the folder ``out``.

    ``version`` is the number of the micro-batch, from 1 on. The amounts of a removed line are NULL, and edits of
    it do nothing from then on; so do edits of lines that ``cart`` lacks. A batch writes folders of its own, from earlier batches
    alone, and its mark last: run again after a loss it replaces what it had begun, and run again after the mark it does nothing.
    """
    spark, n = batch.sparkSession, batch_id + 1
    if is_done(spark, out, n):
        return
    if n > 1 and not is_done(spark, out, n - 1):
        raise ValueError(f"batch {n - 1} is not stored in {out}")
    known = cart.select(*LINE_KEY, *AMOUNTS)
    merge_pieces(summarise_pieces(batch)).join(known, LINE_KEY).write.mode("overwrite").parquet(f"{out}/edits/{n}")
    edited = spark.read.parquet(f"{out}/edits/{n}")
    lines = edited.select(*LINE_KEY, *AMOUNTS, "removed")
    keys = lines.select(*LINE_KEY)
    earlier = [p.join(keys, LINE_KEY, "left_semi") for p in _versions(spark, out, nodes(n - 1))]
    if earlier:
        before = _latest(earlier).select(*LINE_KEY, *[F.col(c).alias(f"__{c}") for c in FIELDS])
        seen = F.col("__removed").isNotNull()
        lines = lines.join(before, LINE_KEY, "left").where(~F.coalesce("__removed", F.lit(False))).select(
            *LINE_KEY, "unit_price",
            *[F.when(seen, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in AMOUNTS[1:]], "removed")
    # Removed lines stay as markers, hence the summary that removes nothing.
    after = apply_summary(lines, edited.drop(*AMOUNTS).withColumn("removed", F.lit(False)))
    after.select(
        *LINE_KEY, *[F.when(~F.col("removed"), F.col(c)).alias(c) for c in AMOUNTS[1:]], "removed",
        F.lit(n).cast("long").alias("version"),
    ).write.mode("overwrite").parquet(f"{out}/versions/{n}")
    if n % 2 == 0:
        own = spark.read.parquet(f"{out}/versions/{n}")
        _latest([own, *_versions(spark, out, inner(n))]).write.mode("overwrite").parquet(f"{out}/nodes/{n}")
    mark_done(spark, out, n)


def stream_versions(edits: DataFrame, cart: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that stores line versions in ``out`` for a stream of valid edits (see ``update_versions``).

    ``cart`` is the priced cart before any edit, stored: each micro-batch reads it once. Within a micro-batch
    edits apply in order of ``seq``, between micro-batches in order of arrival. Without a ``trigger`` all that has
    arrived is taken, in one micro-batch or those that the source's limits cut.
    """
    return (
        edits.writeStream.foreachBatch(lambda batch, batch_id: update_versions(batch, batch_id, cart, out))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def versioned_lines(cart: DataFrame, out: str, upto: int | None = None) -> DataFrame:
    """The cart after all micro-batches stored in ``out``, or the first ``upto``. Reads nodes, no edits."""
    spark = cart.sparkSession
    parts = _versions(spark, out, nodes(last_done(spark, out) if upto is None else upto))
    return current_lines(cart, reduce(DataFrame.unionByName, parts)) if parts else cart
