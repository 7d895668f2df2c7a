"""Totals that follow a stream of edits, against totals of the replayed cart."""

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F
from test_discounts import VALID, random_logs

from quotewright.operators.discounts import replay_edits
from quotewright.operators.totals import quote_totals
from quotewright.plans.queries import QUERIES
from quotewright.schemas import CART, LINE_KEY
from quotewright.sources.carts import PART, StoredCart, store_cart
from quotewright.streaming import totals as live

BATCHES = 7


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A cart, its log by micro-batch, and quotes, one of which has no lines."""
    lines, edits = random_logs(150, seed=23)
    edits.append((999, "unknown", 1, "qty", 1.0))
    folder = str(tmp_path_factory.mktemp("cart"))
    spark.createDataFrame(lines, CART).write.mode("overwrite").parquet(folder)
    cart = spark.read.parquet(folder)
    log = spark.createDataFrame(edits, VALID).withColumn("batch", F.floor(F.col("seq") * BATCHES / 100)).cache()
    quotes = spark.range(52).select(F.col("id").alias("quote_id"), (1 + F.col("id") % 3).cast("int").alias("n_batches"))
    return cart, log, quotes


def batch(log, i):
    return log.where(F.col("batch") == i).drop("batch")


def test_totals_after_every_batch(spark, case, tmp_path):
    cart, log, quotes = case
    out = str(tmp_path / "out")
    live.begin_totals(cart, out)
    assert rows(live.followed_totals(quotes, out)) == rows(quote_totals(cart, quotes))
    for i in range(BATCHES):
        live.update_totals(batch(log, i), i, cart, out)
    assert live.last_done(spark, out) == BATCHES
    for upto in range(1, BATCHES + 1):  # also as they were
        want = quote_totals(replay_edits(cart, log.where(F.col("batch") < upto).drop("batch")), quotes)
        assert rows(live.followed_totals(quotes, out, upto)) == rows(want)


def test_batches_run_again(spark, case, tmp_path, monkeypatch):
    """A batch that was done stays as it is; one that was lost before its mark is replaced."""
    cart, log, quotes = case
    out = str(tmp_path / "out")
    live.begin_totals(cart, out)
    real = live.mark_done
    for i in range(4):
        monkeypatch.setattr(live, "mark_done", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            live.update_totals(batch(log, i), i, cart, out)
        assert live.last_done(spark, out) == i
        monkeypatch.setattr(live, "mark_done", real)
        for _ in range(2):
            live.update_totals(batch(log, i), i, cart, out)
    want = quote_totals(replay_edits(cart, log.where("batch < 4").drop("batch")), quotes)
    assert rows(live.followed_totals(quotes, out)) == rows(want)
    with pytest.raises(ValueError, match="not stored"):
        live.update_totals(batch(log, 5), 5, cart, out)


def test_arrival_order_counts(spark, tmp_path):
    """Numbers that fall from batch to batch do not matter, also within merged nodes."""
    cart = spark.createDataFrame(random_logs(1, seed=0)[0], CART).withColumns(
        {"unit_price": F.lit(10.0), "quantity": F.lit(1.0), "disc_pct": F.lit(0.0), "disc_amt": F.lit(0.0),
         "final_total": F.lit(10.0)})
    key = cart.select("quote_id", "cart_id").first()
    quotes = cart.select("quote_id", F.lit(1).alias("n_batches"))
    out = str(tmp_path / "out")
    live.begin_totals(cart, out)
    nets = []
    for i, (seq, kind, value) in enumerate(
            ((9, "qty", 3.0), (8, "amt", 6.0), (4, "qty", 2.0), (3, "pct", 50.0), (2, "remove", 0.0), (1, "qty", 5.0))):
        live.update_totals(spark.createDataFrame([(*key, seq, kind, value)], VALID), i, cart, out)
        nets.append(live.followed_totals(quotes, out).first()["net_total"])
    assert nets == [30.0, 24.0, 16.0, 10.0, 0.0, 0.0]


def test_stream_with_restarts_on_a_hot_quote_and_an_empty_cart(spark, case, tmp_path):
    cart, log, quotes = case
    hot = cart.withColumn("quote_id", F.lit(7).cast("long"))
    moved = log.drop("batch").withColumn("quote_id", F.lit(7).cast("long"))
    arrived = str(tmp_path / "arrived")
    for name, lines in (("hot", hot), ("none", hot.limit(0))):
        live.begin_totals(lines, str(tmp_path / name))
    for i in range(3):
        moved.where(F.floor(F.col("seq") / 34) == i).write.mode("append").parquet(arrived)
        for name, lines in (("hot", hot), ("none", hot.limit(0))):
            stream = spark.readStream.schema(VALID).parquet(arrived)
            live.stream_totals(stream, lines, str(tmp_path / name), str(tmp_path / f"{name}-log")).awaitTermination()
    for name, lines in (("hot", hot), ("none", hot.limit(0))):
        assert live.last_done(spark, str(tmp_path / name)) == 3
        want = rows(quote_totals(replay_edits(lines, moved), quotes))
        assert rows(live.followed_totals(quotes, str(tmp_path / name))) == want
    plan = live.followed_totals(quotes, str(tmp_path / "hot"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "unit_price" not in plan  # no line is read


@pytest.mark.parametrize("n", range(1, 40))
def test_nodes_cover_the_batches_once(n):
    def batches(node):
        return set(range(node - (node & -node) + 1, node + 1))

    assert sorted(b for m in live._nodes(n) for b in batches(m)) == list(range(1, n + 1))
    assert sorted(b for m in live._inner(n) for b in batches(m)) == sorted(batches(n) - {n})


def test_a_cart_stored_by_quote(spark, case, tmp_path):
    """The same totals, with large quotes in several parts."""
    cart, log, quotes = case
    out = str(tmp_path / "out")
    stored = store_cart(cart, str(tmp_path / "cart"), part_lines=1)
    assert not stored.parts.isEmpty()
    live.begin_totals(stored, out)
    for i in range(3):
        live.update_totals(batch(log, i), i, stored, out)
    want = quote_totals(replay_edits(cart, log.where("batch < 3").drop("batch")), quotes)
    assert rows(live.followed_totals(quotes, out)) == rows(want)


def test_the_query_hands_over_a_stored_cart(spark, monkeypatch):
    """Each of the five micro-batches looks its lines up where they are."""
    seen, real = [], live.update_totals
    monkeypatch.setattr(live, "update_totals", lambda b, i, cart, out: (seen.append(cart), real(b, i, cart, out)))
    QUERIES["stream_quote_totals"](spark, SF_DIR)
    assert len(seen) == 5 and all(isinstance(c, StoredCart) for c in seen)
    assert set(seen[0].lines.columns) == {*LINE_KEY, PART, *live.AMOUNTS}
