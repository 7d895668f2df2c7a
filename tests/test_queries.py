"""Every registered query against its SQL twin, and the shape of some plans."""

import re

import duckdb
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from quotewright.operators.cart import reprice
from quotewright.operators.totals import batch_totals
from quotewright.plans.queries import QUERIES, Book, plain_cart, quotes
from quotewright.plans.views import BASE_TABLES

ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(ORACLES) & set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry_point.entry(spark).columns == [
        "quote_id", "raw_total", "discount_total", "net_total", "n_batches", "project_total", "batch_label"]


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["quote_totals"](spark, SF_DIR))
    lineitem = re.search(r"FileScan parquet \[([^\]]*l_orderkey[^\]]*)\]", text).group(1)
    assert "l_shipdate" not in lineitem and "l_tax" not in lineitem and "l_extendedprice" not in lineitem
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text and "Python" not in text


def test_filters_reach_the_scan(spark):
    raw = spark.read.parquet(f"{SF_DIR}/part.parquet").select(
        F.lit("b").alias("book_id"), F.col("p_partkey").alias("row_ix"), F.col("p_brand").alias("brand"))
    from quotewright.operators.selection import choice_list
    assert "IsNotNull(p_brand)" in plan(choice_list(raw, "brand"))


@pytest.mark.parametrize("name", ["bulk_percent", "bulk_amount", "supplier_discount", "cart_remove", "replay_edits",
                                  "edited_quote_totals"])
def test_carts_and_logs_are_read_once(spark, name):
    text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", text)) == 1
    assert len(re.findall(r"FileScan parquet \[[^\]]*event_id", text)) <= 1


def test_a_hot_quote_is_split(spark, tmp_path):
    """Half of all lines belong to one quote: without broadcasts, the join that prices them
    is split by AQE although the totals need the same key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    prices = Book(spark, SF_DIR)
    cart = plain_cart(spark, SF_DIR, prices).withColumn(
        "id", F.explode(F.sequence(F.lit(0), F.lit(9))))
    cart = cart.withColumns({
        "quote_id": F.when(F.col("id") < 5, F.lit(7)).otherwise(F.col("quote_id")).cast("long"),
        "cart_id": F.concat_ws("-", "quote_id", "cart_id", "id")}).drop("id")
    cart.repartition(16).write.parquet(str(tmp_path / "cart"))
    cart = spark.read.parquet(str(tmp_path / "cart"))
    priced = reprice(cart, quotes(spark, SF_DIR), prices.item_multipliers, prices.service_multipliers)
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        text = plan(batch_totals(priced)).split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "SortMergeJoin(skew=true)" in text and "partial_sum" in text
