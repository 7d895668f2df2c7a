"""Writing quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quotewright.operators.totals import quote_lines, quote_totals


def write_quote_lines(cart: DataFrame, quotes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Line tables of all quotes, one folder per price book. The rebalance keeps the
    number of files per folder small and cuts a large book into several."""
    lines = quote_lines(cart).join(quotes.select("quote_id", "book_id"), "quote_id")
    writer = lines.hint("rebalance", "book_id").write.mode("overwrite").partitionBy("book_id")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_quote_totals(cart: DataFrame, quotes: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = quote_totals(cart, quotes).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
