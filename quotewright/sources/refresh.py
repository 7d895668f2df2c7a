"""Quotes that are written again and again.

A write stores the lines and totals of those price books only whose rows differ from what is stored. Every write that
changes something is a run with folders of its own and a manifest, which names for each book the run whose files hold it;
the mark of the run comes last. So a write that is repeated or lost half-way leaves neither a gap nor a row twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.joins import null_safe_join
from quotewright.operators.totals import quote_lines, quote_totals
from quotewright.schemas import BOOK
from quotewright.sources.digests import digests, row_hash
from quotewright.sources.marks import is_done, last_done, mark_done


KINDS = ("lines", "totals")


def _table(kind: str, cart: DataFrame, quotes: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The table of one kind with its books, or of the books in ``changed`` only."""
    if changed is not None:
        quotes = null_safe_join(quotes, changed, [BOOK], "left_semi")
        if BOOK in cart.columns:
            cart = null_safe_join(cart, changed, [BOOK], "left_semi")
    books = quotes.select("quote_id", BOOK)
    if kind == "totals":
        return quote_totals(cart, quotes).join(books, "quote_id")
    return quote_lines(cart, BOOK) if BOOK in cart.columns else quote_lines(cart).join(books, "quote_id")


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        digests(df.select(BOOK, F.lit(kind).alias("kind"), row_hash(df.columns).alias("sha")), [BOOK, "kind"])
        for kind, df in tables.items()])


def _write(df: DataFrame, path: str) -> DataFrame:
    df.hint("rebalance", BOOK).sortWithinPartitions(BOOK, "quote_id").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _manifest(spark: SparkSession, store: str, run: int) -> DataFrame:
    return spark.read.parquet(f"{store}/manifests/{run}")


def refresh_quotes(cart: DataFrame, quotes: DataFrame, store: str) -> int:
    """Make the folder ``store`` hold the line tables and totals of all ``quotes``; the number of the run that then does.

    Books are compared by digests of their rows, lines and totals apart, so a change of the number of batches
    writes no line again. Books without quotes or lines any more are gone from then on. Quotes without a book
    are kept together, lines of unknown quotes are left out. What changes nothing makes no run. The first run writes
    everything and takes the digests from what it wrote; later ones read ``cart`` for the digests and again for what is
    written, so store it priced. A cart with the column ``book_id``, that of the line's quote, is not joined with the
    quotes for its lines and is read by book; it must have no line of an unknown quote. One write to a store runs at a
    time; readers at any time.
    """
    spark = cart.sparkSession
    last = last_done(spark, store)
    run = last + 1
    tables = {kind: _table(kind, cart, quotes) for kind in KINDS}
    if last:
        before = _manifest(spark, store, last).where(F.col("stored").isNotNull())
        both = _digests(tables).unionByName(before.withColumnRenamed("digest", "was"), allowMissingColumns=True)
    else:
        tables = {kind: _write(df, f"{store}/{kind}/stored={run}") for kind, df in tables.items()}
        both = _digests(tables).withColumns({"was": F.lit(None).cast("string"), "stored": F.lit(None).cast("long")})
    # Grouped and not joined, since a missing book is a key like any other.
    merged = both.groupBy(BOOK, "kind").agg(*[F.max(c).alias(c) for c in ("digest", "was", "stored")])
    stored = F.when(F.col("digest") == F.col("was"), F.col("stored")).when(F.col("digest").isNotNull(), F.lit(run))
    merged.select(BOOK, "kind", "digest", stored.cast("long").alias("stored")).write.mode("overwrite").parquet(
        f"{store}/manifests/{run}")
    if last:
        written = _manifest(spark, store, run)
        if written.where(F.col("stored").isNull() | (F.col("stored") == run)).isEmpty():
            return last
        for kind in KINDS:
            changed = written.where((F.col("kind") == kind) & (F.col("stored") == run)).select(BOOK)
            _write(_table(kind, cart, quotes, changed), f"{store}/{kind}/stored={run}")
    mark_done(spark, store, run)
    return run


def _held(spark: SparkSession, store: str, kind: str, run: int | None) -> DataFrame:
    run = last_done(spark, store) if run is None else run
    if not is_done(spark, store, run):
        raise ValueError(f"{store} holds no run {run or ''}".rstrip())
    wanted = _manifest(spark, store, run).where((F.col("kind") == kind) & F.col("stored").isNotNull())
    files = spark.read.parquet(f"{store}/{kind}").withColumn("stored", F.col("stored").cast("long"))
    return null_safe_join(files.where(F.col("stored") <= run), wanted.select(BOOK, "stored"), [BOOK, "stored"], "left_semi")


def refreshed_lines(spark: SparkSession, store: str, run: int | None = None) -> DataFrame:
    """Line tables under their printed headers with ``book_id`` and ``stored``, the run that wrote them,
    after the last run or an earlier one."""
    return _held(spark, store, "lines", run)


def refreshed_totals(spark: SparkSession, store: str, run: int | None = None) -> DataFrame:
    """Totals of all quotes, likewise."""
    return _held(spark, store, "totals", run)
