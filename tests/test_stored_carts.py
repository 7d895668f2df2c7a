"""Carts stored by quote, against the same operators on a plain cart."""

import re

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F
from test_discounts import VALID, random_logs

from quotewright.operators.cart import reprice
from quotewright.operators.discounts import replay_edits
from quotewright.operators.totals import batch_totals
from quotewright.plans.queries import Book, plain_cart, quotes
from quotewright.schemas import CART, LINE_KEY
from quotewright.sources import carts


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """Half of all lines belong to quote 7, some to none."""
    prices = Book(spark, SF_DIR)
    cart = plain_cart(spark, SF_DIR, prices)
    half, none = F.pmod(F.hash(*LINE_KEY), F.lit(2)) == 0, F.pmod(F.hash(*LINE_KEY), F.lit(40)) == 1
    cart = cart.withColumns({
        "cart_id": F.concat_ws("-", *LINE_KEY),
        "quote_id": F.when(half, F.lit(7).cast("long")).when(~none, F.col("quote_id"))})
    folder = str(tmp_path_factory.mktemp("carts"))
    cart.write.mode("overwrite").parquet(f"{folder}/plain")
    cart = spark.read.parquet(f"{folder}/plain")
    keys = cart.where("quote_id IS NOT NULL").select(*LINE_KEY).where(F.pmod(F.hash("cart_id"), F.lit(3)) == 0)
    edits = keys.select(*LINE_KEY, F.explode(F.expr("array(1L, 2L, 3L)")).alias("seq")).select(
        *LINE_KEY, "seq", F.element_at(F.array(F.lit("qty"), F.lit("amt"), F.lit("qty")), F.col("seq").cast("int")).alias("kind"),
        F.pmod(F.hash("cart_id", "seq"), F.lit(50)).cast("double").alias("value"))
    stored = carts.store_cart(cart, f"{folder}/stored", part_lines=500)
    return cart, edits, stored, quotes(spark, SF_DIR), prices, f"{folder}/stored"


def test_equal_to_a_plain_cart(spark, case):
    cart, edits, stored, quotes_, prices, folder = case
    assert rows(stored.lines, *cart.columns) == rows(cart)
    mults = prices.item_multipliers, prices.service_multipliers
    want = reprice(cart, quotes_, *mults)
    got = carts.reprice_stored(stored, quotes_, *mults)
    assert rows(got.lines, *cart.columns) == rows(want)
    want, got = replay_edits(want, edits), carts.replay_stored(got, edits)
    assert rows(got.lines, *cart.columns) == rows(want)
    assert rows(batch_totals(got.lines)) == rows(batch_totals(want))
    # Another session finds it by its folder.
    again = carts.load_cart(spark, folder)
    assert rows(again.lines, *cart.columns) == rows(cart) and rows(again.parts) == rows(stored.parts)


def test_a_hot_quote_fills_many_buckets(spark, case):
    cart, _, stored, *_ = case
    n = cart.where("quote_id = 7").count()
    assert n > cart.count() / 3
    per_part = stored.lines.where("quote_id = 7").groupBy(carts.PART).count().agg(F.max("count")).first()[0]
    assert per_part < 2 * 500 and dict(rows(stored.parts))[7] == -(-n // 500)
    files = stored.lines.where("quote_id = 7").select(F.input_file_name()).distinct().count()
    assert files >= 4


def above_the_scan(text, scan):
    """Names of the operators above the first scan of ``scan``, from it upwards."""
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and scan in x)
    depth, names = len(re.match(r"[ :+\-*()\d]*", lines[at]).group()), []
    for x in reversed(lines[:at]):
        own = re.match(r"[ :+\-]*", x).group()
        if len(own) < depth:
            names.append(re.sub(r"^\*?\(?\d*\)? ?", "", x[len(own):]))
            depth = len(own)
    return names


def test_lines_are_not_shuffled(spark, case):
    """Without broadcasts no exchange lies between the lines and their partial sums."""
    cart, edits, stored, quotes_, prices, _ = case
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        priced = carts.reprice_stored(stored, quotes_, prices.item_multipliers, prices.service_multipliers)
        df = batch_totals(carts.replay_stored(priced, edits).lines)
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    names = above_the_scan(text, "Bucketed: true")
    upto = next(i for i, x in enumerate(names) if x.startswith("HashAggregate"))
    assert sum("SortMergeJoin" in x for x in names[:upto]) == 2
    assert not any("Exchange" in x for x in names[:upto]) and "partial_sum" in names[upto]


def test_empty_carts_and_refused_columns(spark, tmp_path):
    lines, edits = random_logs(3, seed=1)
    empty = carts.store_cart(spark.createDataFrame([], CART), str(tmp_path / "a"))
    assert rows(carts.replay_stored(empty, spark.createDataFrame(edits, VALID)).lines) == []
    with pytest.raises(ValueError, match="quote_part"):
        carts.store_cart(spark.createDataFrame(lines, CART).withColumn("quote_part", F.lit(1)), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no whole cart"):
        carts.load_cart(spark, str(tmp_path / "b"))


def test_priced_while_stored(spark, case, tmp_path):
    """One shuffle for pricing and buckets; sizes may be too large."""
    cart, _, _, quotes_, prices, _ = case
    mults = prices.item_multipliers, prices.service_multipliers
    sizes = cart.groupBy("quote_id").agg((F.count("*") + 1).alias("n"))
    kept = ["unit_price", "final_total"]
    stored = carts.store_priced(cart, quotes_, *mults, str(tmp_path / "a"), sizes, 16, kept, part_lines=500)
    assert rows(stored.lines, *LINE_KEY, *kept) == rows(reprice(cart, quotes_, *mults), *LINE_KEY, *kept)
    assert set(stored.lines.columns) == {*LINE_KEY, carts.PART, *kept} and dict(rows(stored.parts))[7] > 1
    files = stored.lines.groupBy(F.input_file_name().alias("file")).count()
    assert 4 <= files.count() <= 16  # one task writes a bucket


def test_lines_that_edits_look_up_are_not_shuffled(spark, case):
    cart, edits, stored, *_ = case
    summary = edits.groupBy(*LINE_KEY).agg(F.max("value").alias("value"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = carts.with_lines(summary, stored, ["quantity"])
        names = above_the_scan(found._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    upto = next(i for i, x in enumerate(names) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in names[:upto])
    assert rows(found) == rows(carts.with_lines(summary, cart, ["quantity"]))
