"""Live edits: the log of ``operators.discounts`` as a stream, in two forms.

:func:`stream_edits` keeps every edited line in the state store and emits its new version
after each micro-batch. :func:`stream_summaries` keeps nothing: each micro-batch becomes one
more piece of the log, summarised in the JVM, and a cart is brought up to date when read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quotewright.operators.discounts import apply_summary, condensed, merge_pieces, summarise_pieces
from quotewright.schemas import LINE_KEY
from quotewright.session import ship_by_value

AMOUNTS = ["unit_price", "quantity", "disc_pct", "disc_amt", "final_total"]
STATE = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in AMOUNTS],
    T.StructField("removed", T.BooleanType()),
    T.StructField("version", T.LongType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ship_by_value(__name__)


def _missing(value: float | None) -> bool:
    return value is None or value != value


def fold(line: dict, kinds: list[str], values: list[float]) -> dict:
    """One line after some valid edits, in the order given."""
    price, qty, pct, amt, total = (line[n] for n in AMOUNTS)
    removed = line["removed"]
    editable = not any(map(_missing, (price, qty, pct)))
    for kind, value in zip(kinds, values):
        removed = removed or kind == "remove"
        if removed or not editable:
            continue
        qty = value if kind == "qty" else qty
        gross = price * qty
        if kind == "amt":
            pct, amt = (value / gross * 100.0 if gross > 0 else 0.0), value
        else:
            pct = value if kind == "pct" else pct
            amt = gross * (pct / 100.0)
        if gross - amt < 0:
            pct, amt = 100.0, gross
        total = gross - amt
    return {"unit_price": price, "quantity": qty, "disc_pct": pct, "disc_amt": amt,
            "final_total": total, "removed": removed, "version": line["version"] + len(kinds)}


class LineEdits(StatefulProcessor):
    """State of one line: its amounts after the edits so far. The first edit brings the
    line's amounts in the cart along. A removed line keeps its state as a marker, since
    later edits of it must be ignored. Most lines have few edits, so these are plain rows;
    a data frame for each line takes many times longer than its edits."""

    def init(self, handle) -> None:
        self.line = handle.getValueState("line", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        edits = sorted(rows, key=lambda r: r["seq"])
        if self.line.exists():
            line = dict(zip(STATE.fieldNames(), self.line.get()))
            if line["removed"]:
                return
        else:
            line = {n: None if _missing(edits[0][n]) else edits[0][n] for n in AMOUNTS}
            line |= {"removed": False, "version": 0}
        line = fold(line, [r["kind"] for r in edits], [r["value"] for r in edits])
        self.line.update(tuple(line[n] for n in STATE.fieldNames()))
        yield Row(**dict(zip(LINE_KEY, key)), **line)

    def close(self) -> None:
        pass


def stream_edits(edits: DataFrame, cart: DataFrame, output_mode: str = "Append") -> DataFrame:
    """A stream of valid edits (see ``resolve_edits``) -> a stream of line versions.

    The cart is a table the stream is joined with, so only edited lines enter the state
    store and edits of unknown lines fall away. Within a micro-batch edits apply in order
    of ``seq``; between micro-batches in order of arrival. There is no watermark. ``cart`` is
    read again in every micro-batch, so store it priced. Sets the session's state store
    provider to RocksDB.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key_types = [f for f in cart.schema.fields if f.name in LINE_KEY]
    return (
        edits.select(*LINE_KEY, "seq", "kind", "value")
        .join(cart.select(*LINE_KEY, *AMOUNTS), LINE_KEY)
        .groupBy(*LINE_KEY)
        .transformWithState(
            statefulProcessor=LineEdits(),
            outputStructType=T.StructType([*key_types, *STATE.fields]),
            outputMode=output_mode, timeMode="None")
    )


def run_to_table(spark: SparkSession, versions: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain the stream's source into the Parquet folder ``out`` and return it as a table.
    The file sink's log makes a restarted run add no row twice. Both folders must be ones
    that all executors reach."""
    query = (
        versions.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", out).option("checkpointLocation", checkpoint).start()
    )
    query.awaitTermination()
    return spark.read.schema(versions.schema).parquet(out)


def current_lines(cart: DataFrame, versions: DataFrame) -> DataFrame:
    """The cart with each line in its latest version."""
    fields = [*AMOUNTS[1:], "removed"]
    latest = versions.groupBy(*LINE_KEY).agg(
        *[F.max_by(c, "version").alias(f"__{c}") for c in fields],
        F.max(F.lit(True)).alias("__edited"))
    return (
        cart.join(latest, LINE_KEY, "left")
        .where(~F.coalesce("__removed", F.lit(False)))
        .select(*[F.when(F.col("__edited"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
                  if c in fields else F.col(c) for c in cart.columns])
    )


# --- without a state store ---------------------------------------------------------------

BATCH = "batch_id"


def stream_summaries(edits: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that stores, per micro-batch, one summary row for each line it edits.

    A batch owns its folder and overwrites it when it is run again, so a restart after a
    lost driver leaves neither gaps nor repeats.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        merged = merge_pieces(summarise_pieces(batch)).drop("qty_piece", "some_piece", "disc_piece")
        merged.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return (
        edits.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


class Base(NamedTuple):
    """A folder with one row per line for all micro-batches up to ``upto``."""

    path: str
    upto: int


def _pieces(spark: SparkSession, out: str, base: Base | None) -> DataFrame:
    """The base, if there is one, and the summaries of the micro-batches after it."""
    tail = spark.read.parquet(out).withColumn("piece", F.col(BATCH).cast("long"))
    if base is None:
        return tail.drop(BATCH)
    tail = tail.where(F.col(BATCH) > base.upto).drop(BATCH)  # older folders are not read
    earlier = spark.read.parquet(base.path).withColumn("piece", F.lit(base.upto).cast("long"))
    return earlier.unionByName(tail)


def compact_summaries(spark: SparkSession, out: str, path: str, upto: int, base: Base | None = None) -> Base:
    """Merge all micro-batches up to ``upto`` into one row per line, in the new folder ``path``.

    Builds on an earlier ``base``, if given. ``upto`` must be below the number of the last
    micro-batch, which a restart may write again. Folders that a base covers may be deleted.
    """
    pieces = _pieces(spark, out, base).where(F.col("piece") <= upto)
    condensed(merge_pieces(pieces)).write.parquet(path)
    return Base(path, upto)


def apply_summaries(spark: SparkSession, cart: DataFrame, out: str, base: Base | None = None) -> DataFrame:
    """The cart after all micro-batches stored in ``out``, in order of arrival."""
    return apply_summary(cart, merge_pieces(_pieces(spark, out, base)))
