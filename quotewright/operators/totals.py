"""Totals per quote and the shapes they are printed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.values import fixed_cents, is_set, total
from quotewright.schemas import LINE_KEY

# Headers and labels as printed on a quote.
QUOTE_VIEW = {
    "product_code": "Code", "name": "Name", "description": "Description", "type": "Type",
    "unit_price": "Unit Price", "quantity": "Quantity", "disc_pct": "Discount %",
    "disc_amt": "Discount $", "final_total": "Total",
}
QUOTE_LINES = {
    "name": "Item", "unit_price": "Amount", "description": "Description", "quantity": "Quantity",
    "disc_pct": "Discount %", "disc_amt": "Discount $", "final_total": "Total Amount [AUD]",
}
BATCH_TOTAL, PROJECT_TOTAL, BATCHES = "Total (Per Batch): $", " | Total Project (", " batches): $"
NO_TOTAL = "Total (Per Batch): $0.00"
HEADER = [
    ("Title", "title"), ("Date:", "date"), ("Quote ID:", "quote_id"),
    ("Project ID:", "project_id"), ("Project Title:", "title"), ("Platform:", "platform"),
    ("Total # samples:", "n_samples"), ("# batches:", "n_batches"),
    ("# samples per batch:", "samples_per_batch"), ("Aimed # cells per sample:", "aimed_cells"),
]


def batch_totals(cart: DataFrame) -> DataFrame:
    """Per quote: gross, discount and net of one batch; NULL amounts do not count."""
    return cart.groupBy("quote_id").agg(
        total(F.col("unit_price") * F.col("quantity")).alias("raw_total"),
        total(F.col("disc_amt")).alias("discount_total"),
        total(F.col("final_total")).alias("net_total"),
        F.count("*").alias("n_lines"),
    )


def _for_every_quote(quotes: DataFrame, totals: DataFrame) -> DataFrame:
    sums = ["raw_total", "discount_total", "net_total"]
    return quotes.join(totals, "quote_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in sums}
        | {"n_lines": F.coalesce("n_lines", F.lit(0))})


def project_totals(totals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Totals of all batches of every quote; a quote without lines is worth zero."""
    return _for_every_quote(quotes.select("quote_id", "n_batches"), totals).select(
        "quote_id", "raw_total", "discount_total", "net_total", "n_batches",
        (F.col("net_total") * F.col("n_batches")).alias("project_total"),
        F.when(F.col("n_batches") > 1, "batches").otherwise("batch").alias("batch_label"),
    )


def quote_totals(cart: DataFrame, quotes: DataFrame) -> DataFrame:
    return project_totals(batch_totals(cart), quotes)


def invoice_totals(cart: DataFrame, quotes: DataFrame) -> DataFrame:
    """The invoice's own net: gross less discount instead of the sum of line totals."""
    totals = batch_totals(cart).withColumn("net_total", F.col("raw_total") - F.col("discount_total"))
    return project_totals(totals, quotes)


def total_text() -> Column:
    """The grand total as printed, from the columns ``net_total``, ``n_batches``, ``n_lines`` and both surcharges."""
    shown = F.concat(
        F.lit(BATCH_TOTAL), fixed_cents(F.col("net_total"), grouped=True),
        F.lit(PROJECT_TOTAL), F.col("n_batches").cast("string"), F.lit(BATCHES),
        fixed_cents(F.col("net_total") * F.col("n_batches"), grouped=True),
    )
    ready = ((F.col("n_lines") > 0) & is_set(F.col("item_surcharge"))
             & is_set(F.col("service_surcharge")))
    return F.when(ready, shown).otherwise(NO_TOTAL)


def grand_total_text(cart: DataFrame, quotes: DataFrame) -> DataFrame:
    wanted = quotes.select("quote_id", "n_batches", "item_surcharge", "service_surcharge")
    return _for_every_quote(wanted, batch_totals(cart)).select("quote_id", total_text().alias("text"))


def quote_view(cart: DataFrame, quotes: DataFrame) -> DataFrame:
    """Review columns of every line whose quote has both surcharges set."""
    ready = quotes.where(is_set(F.col("item_surcharge")) & is_set(F.col("service_surcharge")))
    return cart.join(ready.select("quote_id"), "quote_id", "left_semi").select(
        *LINE_KEY, *[F.col(c).alias(h) for c, h in QUOTE_VIEW.items()])


def quote_lines(cart: DataFrame, *more: str) -> DataFrame:
    """Line table of the internal quote under its printed headers, and the columns ``more`` as they are."""
    return cart.select(*LINE_KEY, *[F.col(c).alias(h) for c, h in QUOTE_LINES.items()], *more)


def invoice_lines(cart: DataFrame) -> DataFrame:
    """What the client sees: prices as text, no discounts per line."""
    def dollars(c: str):
        return F.concat(F.lit("$"), F.coalesce(fixed_cents(F.col(c)), F.lit("NA")))

    return cart.select(
        *LINE_KEY, F.col("name").alias("Item"), dollars("unit_price").alias("Amount"),
        F.coalesce("description", F.lit("")).alias("Description"),
        F.col("quantity").alias("Quantity"), dollars("final_total").alias("Total Amount [AUD]"))


def quote_header(quotes: DataFrame) -> DataFrame:
    """Metadata lines at the top of a quote, one row per label, paired by name."""
    lines = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"),
                 F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
        for i, (label, c) in enumerate(HEADER, start=1)
    ])
    return quotes.select("quote_id", F.inline(lines))
