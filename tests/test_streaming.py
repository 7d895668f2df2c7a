import pytest
from conftest import rows
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_discounts import SHOWN, VALID, random_logs

from quotewright.operators.discounts import replay_edits
from quotewright.schemas import CART
from quotewright.streaming import edits as live


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """A log cut into files by time, which a stream reads one per micro-batch."""
    lines, edits = random_logs(120, seed=11)
    edits.append((999, "unknown", 1, "qty", 1.0))
    folder = str(tmp_path_factory.mktemp("edits"))
    log = spark.createDataFrame(edits, VALID)
    for i in range(3):
        part = log.where(F.floor(F.col("seq") / 34) == i).coalesce(1)
        part.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(VALID).option("maxFilesPerTrigger", 1).parquet(folder)
    return spark.createDataFrame(lines, CART), log, stream


def test_stateful_stream_equals_replay(spark, case, tmp_path):
    cart, log, stream = case
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    versions = live.run_to_table(spark, live.stream_edits(stream, cart), out, checkpoint)
    assert rows(live.current_lines(cart, versions), *SHOWN) == rows(replay_edits(cart, log), *SHOWN)
    n = versions.count()
    # Nothing new: a restart from the same checkpoint adds nothing.
    assert live.run_to_table(spark, live.stream_edits(stream, cart), out, checkpoint).count() == n


def test_summary_stream_equals_replay(spark, case, tmp_path):
    cart, log, stream = case
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    live.stream_summaries(stream, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    assert rows(live.apply_summaries(spark, cart, out), *SHOWN) == rows(replay_edits(cart, log), *SHOWN)


def test_compaction_keeps_results_and_bounds_the_pieces(spark, case, tmp_path):
    cart, log, stream = case
    out = str(tmp_path / "out")
    live.stream_summaries(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    want = rows(replay_edits(cart, log), *SHOWN)
    first = live.compact_summaries(spark, out, str(tmp_path / "base-0"), 0)
    second = live.compact_summaries(spark, out, str(tmp_path / "base-1"), 1, first)
    for base in (first, second):
        assert rows(live.apply_summaries(spark, cart, out, base), *SHOWN) == want
        stored = spark.read.parquet(base.path)
        assert stored.count() == stored.select("quote_id", "cart_id").distinct().count()
    text = live.apply_summaries(spark, cart, out, second)._jdf.queryExecution().executedPlan().toString()
    assert "(batch_id" in text and "> 1)" in text  # folders that the base covers are not read


def test_compaction_keeps_the_order_of_arrival(spark, tmp_path):
    """An amount that arrives last counts last, whatever its number."""
    cart = spark.createDataFrame(random_logs(1, seed=0)[0], CART).withColumns(
        {"unit_price": F.lit(10.0), "quantity": F.lit(1.0), "disc_pct": F.lit(0.0)})
    key = cart.select("quote_id", "cart_id").first()
    folder, out = str(tmp_path / "edits"), str(tmp_path / "out")
    for seq, kind, value in ((9, "qty", 3.0), (4, "amt", 6.0), (2, "qty", 2.0), (1, "pct", 50.0)):
        spark.createDataFrame([(*key, seq, kind, value)], VALID).coalesce(1).write.mode("append").parquet(folder)
        live.stream_summaries(spark.readStream.schema(VALID).parquet(folder), out, str(tmp_path / "cp")).awaitTermination()
    want = rows(live.apply_summaries(spark, cart, out), *SHOWN)
    assert want[0][2:4] == (2.0, 50.0)
    for upto in range(3):
        base = live.compact_summaries(spark, out, str(tmp_path / f"base-{upto}"), upto)
        assert rows(live.apply_summaries(spark, cart, out, base), *SHOWN) == want


def test_arrival_order_wins_across_batches(spark, tmp_path):
    """The second file holds an earlier number, yet comes later."""
    cart = spark.createDataFrame(random_logs(1, seed=0)[0], CART).withColumns(
        {"unit_price": F.lit(10.0), "quantity": F.lit(1.0), "disc_pct": F.lit(0.0)})
    key = cart.select("quote_id", "cart_id").first()
    folder = str(tmp_path / "edits")
    for seq, value in ((9, 3.0), (4, 7.0)):
        spark.createDataFrame([(*key, seq, "qty", value)], VALID).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(VALID).parquet(folder)
        live.stream_summaries(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(live.apply_summaries(spark, cart, str(tmp_path / "out")), "quantity") == [(7.0,)]


def test_a_lines_edits_are_folded_as_rows():
    """No data frame per line; NaN amounts count as missing, and a removed line stays as it is."""
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    line = live.LineEdits()
    line.line = Value()
    first = {"unit_price": 10.0, "quantity": 1.0, "disc_pct": 0.0, "disc_amt": float("nan"), "final_total": 10.0}

    def after(*edits):
        found = list(line.handleInputRows((7, "x"), iter([Row(seq=s, kind=k, value=v, **first) for s, k, v in edits]), None))
        assert all(isinstance(r, Row) and (r.quote_id, r.cart_id) == (7, "x") for r in found)
        return [(r.quantity, r.disc_pct, r.disc_amt, r.final_total, r.removed, r.version) for r in found]

    assert after((2, "pct", 50.0), (1, "qty", 4.0)) == [(4.0, 50.0, 20.0, 20.0, False, 2)]
    assert after((0, "qty", 2.0)) == [(2.0, 50.0, 10.0, 10.0, False, 3)]
    assert after((5, "remove", None)) == [(2.0, 50.0, 10.0, 10.0, True, 4)]
    assert after((6, "qty", 9.0)) == []
