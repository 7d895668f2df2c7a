"""Line versions that follow a stream of edits, against the replayed cart."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_discounts import SHOWN, VALID, random_logs

from quotewright.operators.discounts import replay_edits
from quotewright.schemas import CART
from quotewright.streaming import versions as live

BATCHES = 6


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A cart, and its log by micro-batch with an edit of a line that the cart lacks."""
    lines, edits = random_logs(150, seed=5)
    edits.append((999, "unknown", 1, "qty", 1.0))
    folder = str(tmp_path_factory.mktemp("cart"))
    spark.createDataFrame(lines, CART).write.mode("overwrite").parquet(folder)
    log = spark.createDataFrame(edits, VALID).withColumn("batch", F.floor(F.col("seq") * BATCHES / 100)).cache()
    return spark.read.parquet(folder), log


def batch(log, i):
    return log.where(F.col("batch") == i).drop("batch")


def test_lines_after_every_batch(spark, case, tmp_path):
    cart, log = case
    out = str(tmp_path)
    assert rows(live.versioned_lines(cart, out)) == rows(cart)
    for i in range(BATCHES):
        live.update_versions(batch(log, i), i, cart, out)
    for upto in range(1, BATCHES + 1):  # also as they were
        want = replay_edits(cart, log.where(F.col("batch") < upto).drop("batch"))
        assert rows(live.versioned_lines(cart, out, upto), *SHOWN) == rows(want, *SHOWN)
    node = spark.read.parquet(f"{out}/nodes/4")
    assert node.count() == node.select("quote_id", "cart_id").distinct().count()
    removed = node.where("removed")
    assert removed.count() and removed.where("quantity IS NOT NULL OR final_total IS NOT NULL").isEmpty()


def test_batches_run_again(spark, case, tmp_path, monkeypatch):
    """A batch that was lost before its mark is replaced; one that was done stays."""
    cart, log = case
    out = str(tmp_path)
    real = live.mark_done
    for i in range(4):
        monkeypatch.setattr(live, "mark_done", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            live.update_versions(batch(log, i), i, cart, out)
        assert live.last_done(spark, out) == i
        monkeypatch.setattr(live, "mark_done", real)
        for _ in range(2):
            live.update_versions(batch(log, i), i, cart, out)
    want = replay_edits(cart, log.where("batch < 4").drop("batch"))
    assert rows(live.versioned_lines(cart, out), *SHOWN) == rows(want, *SHOWN)
    with pytest.raises(ValueError, match="not stored"):
        live.update_versions(batch(log, 5), 5, cart, out)


def test_arrival_order_counts(spark, tmp_path):
    cart = spark.createDataFrame(random_logs(1, seed=0)[0], CART).withColumns(
        {"unit_price": F.lit(10.0), "quantity": F.lit(1.0), "disc_pct": F.lit(0.0), "disc_amt": F.lit(0.0),
         "final_total": F.lit(10.0)})
    key = cart.select("quote_id", "cart_id").first()
    seen = []
    for i, (seq, kind, value) in enumerate(
            ((9, "qty", 3.0), (8, "amt", 6.0), (4, "qty", 2.0), (3, "pct", 50.0), (2, "remove", 0.0), (1, "qty", 5.0))):
        live.update_versions(spark.createDataFrame([(*key, seq, kind, value)], VALID), i, cart, str(tmp_path))
        seen.append(rows(live.versioned_lines(cart, str(tmp_path)), "quantity", "final_total"))
    assert seen == [[(3.0, 30.0)], [(3.0, 24.0)], [(2.0, 16.0)], [(2.0, 10.0)], [], []]


def test_stream_with_restarts_on_a_hot_quote(spark, case, tmp_path):
    cart, log = case
    hot = cart.withColumn("quote_id", F.lit(7).cast("long"))
    moved = log.drop("batch").withColumn("quote_id", F.lit(7).cast("long"))
    arrived = str(tmp_path / "arrived")
    for i in range(3):
        moved.where(F.floor(F.col("seq") / 34) == i).write.mode("append").parquet(arrived)
        for name, lines in (("hot", hot), ("none", hot.limit(0))):
            stream = spark.readStream.schema(VALID).parquet(arrived)
            live.stream_versions(stream, lines, str(tmp_path / name), str(tmp_path / f"{name}-log")).awaitTermination()
    assert live.last_done(spark, str(tmp_path / "hot")) == 3
    got = live.versioned_lines(hot, str(tmp_path / "hot"))
    assert rows(got, *SHOWN) == rows(replay_edits(hot, moved), *SHOWN)
    assert rows(live.versioned_lines(hot.limit(0), str(tmp_path / "none"))) == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_versions_are_combined_by_hashing(spark, case, tmp_path):
    cart, log = case
    for i in range(3):
        live.update_versions(batch(log, i), i, cart, str(tmp_path))
    parts = live._versions(spark, str(tmp_path), live.nodes(3))
    plan = live._latest(parts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and "SortAggregate" not in plan
