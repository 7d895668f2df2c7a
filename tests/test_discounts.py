import random

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_catalog_cart import line

from quotewright.operators import discounts as d
from quotewright.schemas import CART
from quotewright.streaming.edits import AMOUNTS, fold

VALID = "quote_id long, cart_id string, seq long, kind string, value double"
LOGGED = "quote_id long, cart_id string, seq long, op string, value double, display_text string"
SHOWN = ["quote_id", "cart_id", "quantity", "disc_pct", "disc_amt", "final_total"]


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame([(1, "b"), (2, "c")], "quote_id long, book_id string")


@pytest.fixture(scope="module")
def offers(spark):
    return spark.createDataFrame(
        [("b", "S | L | 20%", 0.2, "percentage"), ("b", "S | L | $30", 30.0, "amount"),
         ("b", "twice", 1.0, "amount"), ("b", "twice", 2.0, "amount"), ("b", "odd", 1.0, "voucher")],
        "book_id string, display_text string, amount double, type string")


def priced(spark, *lines):
    return spark.createDataFrame(lines or [line(1, "x", price=100.0, qty=1.0, pct=0.0, total=100.0)], CART)


def test_the_written_example(spark, quotes, offers):
    """The same events, one more at a time, against their expected outcomes."""
    events = [
        ("qty", 3.0, (3.0, 0.0, 0.0, 300.0)), ("pct", 10.0, (3.0, 10.0, 30.0, 270.0)),
        ("amt", 60.0, (3.0, 20.0, 60.0, 240.0)), ("qty", 1.0, (1.0, 20.0, 20.0, 80.0)),
        ("amt", 500.0, (1.0, 100.0, 100.0, 0.0)), ("pct", -5.0, (1.0, 100.0, 100.0, 0.0)),
        ("bulk_pct", 120.0, (1.0, 100.0, 100.0, 0.0)), ("qty", 0.0, (0.0, 100.0, 0.0, 0.0)),
        ("amt", 0.0, (0.0, 0.0, 0.0, 0.0)), ("amt", 5.0, (0.0, 100.0, 0.0, 0.0)),
    ]
    # Quote n is a copy that sees the first n events.
    n = len(events)
    cart = priced(spark, *[line(q, "x", price=100.0, qty=1.0, pct=0.0, total=100.0) for q in range(1, n + 1)])
    log = spark.createDataFrame([(q, "x", i, op, v, None) for q in range(1, n + 1)
                                 for i, (op, v, _) in enumerate(events[:q])], LOGGED)
    books = spark.createDataFrame([(q, "b") for q in range(1, n + 1)], "quote_id long, book_id string")
    for seq_range in (1 << 20, 3, 1):
        got = d.replay_edits(cart, d.resolve_edits(log, books, offers), seq_range)
        assert [r[2:] for r in rows(got, *SHOWN)] == [want for _, _, want in events]


def test_resolving(spark, quotes, offers):
    def ops(*events):
        log = spark.createDataFrame([(1, "x", i, op, v, t) for i, (op, v, t) in enumerate(events)], LOGGED)
        return rows(d.resolve_edits(log, quotes, offers), "seq", "kind", "value")

    nan, inf = float("nan"), float("inf")
    assert ops(("qty", -1.0, None), ("qty", None, None), ("pct", nan, None), ("amt", inf, None),
               ("bulk_pct", 100.5, None), ("bulk_pct", 100.0, None), ("bulk_amt", 5.0, None),
               ("remove", None, None), ("pct", 150.0, None), ("what", 1.0, None)) == [
        (5, "pct", 100.0), (6, "amt", 5.0), (7, "remove", None), (8, "pct", 150.0)]
    assert ops(("supplier", None, "S | L | 20%"), ("supplier", 1.0, "S | L | $30"),
               ("supplier", None, "twice"), ("supplier", None, "odd"), ("supplier", None, "none"),
               ("supplier", None, None)) == [(0, "pct", 20.0), (1, "amt", 30.0)]
    assert rows(d.ambiguous_discounts(offers), "display_text") == [("twice",)]


def test_bulk_and_supplier(spark, quotes, offers):
    cart = priced(spark, *[line(q, c, price=p, qty=2.0, pct=0.0, total=200.0)
                           for q, c, p in ((1, "x", 100.0), (1, "y", 10.0), (1, "z", 100.0), (2, "x", None))])
    chosen = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "quote_id long, cart_id string")
    keep = [(1, "z", 2.0, 0.0, 0.0, 200.0), (2, "x", 2.0, 0.0, 0.0, 200.0)]
    assert rows(d.bulk_percent(cart, chosen, 25), *SHOWN) == [
        (1, "x", 2.0, 25.0, 50.0, 150.0), (1, "y", 2.0, 25.0, 5.0, 15.0), *keep]
    by_key = F.concat_ws("/", "quote_id", "cart_id").isin(["/".join(map(str, r)) for r in chosen.collect()])
    assert rows(d.bulk_percent(cart, by_key, 25)) == rows(d.bulk_percent(cart, chosen, 25))
    assert rows(d.bulk_amount(cart, chosen, 50), *SHOWN) == [
        (1, "x", 2.0, 25.0, 50.0, 150.0), (1, "y", 2.0, 100.0, 20.0, 0.0), *keep]
    for rejected in (d.bulk_percent(cart, chosen, 101), d.bulk_percent(cart, chosen, -1),
                     d.bulk_amount(cart, chosen, -1), d.bulk_amount(cart, chosen, float("nan"))):
        assert rows(rejected) == rows(cart)
    named = chosen.withColumn("display_text", F.lit("S | L | $30"))
    assert rows(d.supplier_discount(cart, named, quotes, offers), *SHOWN) == [
        (1, "x", 2.0, 15.0, 30.0, 170.0), (1, "y", 2.0, 100.0, 20.0, 0.0), *keep]
    for useless in ("twice", "odd", ""):
        named = chosen.withColumn("display_text", F.lit(useless))
        assert rows(d.supplier_discount(cart, named, quotes, offers)) == rows(cart)


def random_logs(n_lines, seed):
    rng = random.Random(seed)
    lines, edits = [], []
    for i in range(n_lines):
        price = rng.choice([None, 0.0, -7.25, 19.99, 100.0, 1234.5, 0.1])
        qty, pct = rng.choice([0.0, 1.0, 3.0]), rng.choice([0.0, 10.0, 33.3, 150.0])
        lines.append(line(i % 50, f"k{i}", price=price, qty=qty, pct=pct, amt=1.0, total=2.0))
        for seq in sorted(rng.sample(range(100), rng.randint(0, 12))):
            kind = rng.choice(["qty"] * 5 + ["pct"] * 3 + ["amt"] * 3 + (["remove"] if i % 9 == 0 else []))
            value = rng.choice([0.0, 1.0, 2.0, 7.0, 12.5, 99.9, 100.0, 100.1, 400.0])
            edits.append((i % 50, f"k{i}", seq, kind, value))
    rng.shuffle(edits)
    return lines, edits


@pytest.mark.parametrize("seq_range, widths", [
    (1 << 20, ()), (10, ()), (1, ()), (1, (7,)), (2, (3, 4)), (1, (1000,))])
def test_replay_equals_one_edit_after_another(spark, seq_range, widths):
    lines, edits = random_logs(3000, seed=seq_range)
    got = d.replay_edits(spark.createDataFrame(lines, CART), spark.createDataFrame(edits, VALID), seq_range,
                         widths)
    by_line = {}
    for q, c, seq, kind, value in sorted(edits, key=lambda e: e[2]):
        by_line.setdefault((q, c), []).append((kind, value))
    want = []
    for row in lines:
        state = dict(zip(CART.names, row))
        start = {**{n: state[n] for n in AMOUNTS}, "removed": False, "version": 0}
        done = by_line.get((row[0], row[1]), [])
        after = fold(start, [k for k, _ in done], [v for _, v in done])
        if not after["removed"]:
            want.append((row[0], row[1], *[after[n] for n in AMOUNTS[1:]]))
    assert rows(got, *SHOWN) == sorted(want)


def test_replay_equals_repeated_single_edits(spark):
    lines, edits = random_logs(300, seed=5)
    cart, log = spark.createDataFrame(lines, CART), spark.createDataFrame(edits, VALID)
    steps = cart
    ranked = {}
    for e in sorted(edits, key=lambda e: e[2]):
        ranked.setdefault((e[0], e[1]), []).append(e)
    for n in range(max(map(len, ranked.values()))):
        batch = [es[n] for es in ranked.values() if len(es) > n]
        steps = spark.createDataFrame(
            d.apply_edits(steps, spark.createDataFrame(batch, VALID)).collect(), CART)
    assert rows(d.replay_edits(cart, log), *SHOWN) == rows(steps, *SHOWN)


amounts = st.floats(0, 1e6)


@given(st.floats(0, 1e5), st.lists(st.tuples(st.sampled_from(["qty", "pct", "amt"]), amounts), min_size=1))
def test_a_discount_never_exceeds_the_price(price, edits):
    start = dict(zip(AMOUNTS, (price, 1.0, 0.0, 0.0, price)), removed=False, version=0)
    after = fold(start, [k for k, _ in edits], [v for _, v in edits])
    assert 0 <= after["final_total"] <= price * after["quantity"]


EDITORS = {
    # The edit in SQL: new quantity, percentage and amount before a discount above the price is cut.
    "edit_quantity": ("v", "disc_pct", "unit_price * v * (disc_pct / 100)"),
    "edit_percent": ("quantity", "v", "unit_price * quantity * (v / 100)"),
    "edit_amount": ("quantity", "CASE WHEN unit_price * quantity > 0 THEN v / (unit_price * quantity) * 100 ELSE 0 END", "v"),
}


@pytest.mark.parametrize("name", EDITORS)
def test_single_editors_equal_their_sql(spark, name):
    import duckdb

    rng = random.Random(name)
    lines = [line(q, f"l{i}", price=rng.choice([None, 0.0, 10.0, 99.5]), qty=rng.choice([0.0, 1.0, 3.0]),
                  pct=rng.choice([0.0, 20.0, 100.0]), total=7.0) for q in (1, 2) for i in range(40)]
    cart = priced(spark, *lines)
    edits = [(q, f"l{i}", rng.choice([None, -1.0, 0.0, 2.0, 50.0, 150.0, 1000.0]))
             for q in (1, 3) for i in range(0, 60, rng.choice([1, 2]))]
    got = getattr(d, name)(cart, spark.createDataFrame(edits, "quote_id long, cart_id string, value double"))
    db = duckdb.connect()
    db.sql("CREATE TABLE cart (quote_id BIGINT, cart_id TEXT, unit_price DOUBLE, quantity DOUBLE, disc_pct DOUBLE, "
           "disc_amt DOUBLE, final_total DOUBLE)")
    db.sql("CREATE TABLE edits (quote_id BIGINT, cart_id TEXT, v DOUBLE)")
    db.executemany("INSERT INTO cart VALUES (?, ?, ?, ?, ?, ?, ?)", [list(r) for r in cart.select(
        "quote_id", "cart_id", "unit_price", "quantity", "disc_pct", "disc_amt", "final_total").collect()])
    db.executemany("INSERT INTO edits VALUES (?, ?, ?)", [list(e) for e in edits])
    quantity, pct, amount = EDITORS[name]
    expected = db.sql(f"""
        WITH edited AS (
          SELECT *, coalesce(v >= 0 AND unit_price IS NOT NULL, false) AS ok, {quantity} AS q, {pct} AS p, {amount} AS a
          FROM cart LEFT JOIN edits USING (quote_id, cart_id)),
        cut AS (SELECT *, unit_price * q AS gross, coalesce(unit_price * q - a < 0, false) AS above FROM edited)
        SELECT quote_id, cart_id, CASE WHEN ok THEN q ELSE quantity END,
          CASE WHEN NOT ok THEN disc_pct WHEN above THEN 100 ELSE p END,
          CASE WHEN NOT ok THEN disc_amt WHEN above THEN gross ELSE a END,
          CASE WHEN NOT ok THEN final_total WHEN above THEN 0 ELSE gross - a END
        FROM cut ORDER BY quote_id, cart_id""").fetchall()
    assert len(expected) == len(lines) and any(e[2:] != tuple(g) for e, g in zip(
        expected, sorted(cart.select(*SHOWN).collect())))
    assert rows(got, *SHOWN) == expected
