"""Scans, logs with changing surcharges, totals after events and carts with additions, against one event at a time."""

import random

import pytest
from conftest import rows

from quotewright.operators import cart_log
from quotewright.operators import discounts as d
from quotewright.operators.scans import running
from quotewright.schemas import CART
from pyspark.sql import functions as F

RANGES = [(1, 8), (7, 49, 343), (1 << 12, 1 << 24)]
EDITS = "quote_id long, cart_id string, seq long, kind string, value double"
QUOTES = "quote_id long, book_id long, item_surcharge string, service_surcharge string, n_batches int"
MULTIPLIERS = "book_id long, label string, multiplier double, label_ix long"
SHOWN = ("quote_id", "cart_id", "unit_price", "quantity", "disc_pct", "disc_amt", "final_total")


@pytest.fixture
def store(tmp_path, spark):
    def run(df):
        run.n += 1
        df.write.parquet(str(tmp_path / f"t{run.n}"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / f"t{run.n}"))

    run.n = 0
    return run


@pytest.mark.parametrize("ranges", RANGES)
def test_running_values(spark, ranges):
    rng = random.Random(1)
    made = [(rng.choice("aaaaab"), s, t, rng.choice([None, 1, 5, -2, 7])) for s in rng.sample(range(-500, 500), 300) for t in (0, 1)]
    df = spark.createDataFrame(made, "k string, at long, t long, v long")
    x = F.col("v")
    got = running(df, ["k"], "at", last={"l": x}, most={"m": x}, sums={"s": x}, tie=["t"], ranges=ranges)
    want = []
    for k, at, t, v in made:
        upto = [w for j, a, u, w in sorted(made, key=lambda r: r[1:3]) if j == k and (a, u) <= (at, t) and w is not None]
        before = [w for j, a, u, w in sorted(made, key=lambda r: r[1:3]) if j == k and (a, u) < (at, t) and w is not None]
        want.append((k, at, t, v, upto[-1] if upto else None, before[-1] if before else None, max(upto, default=None),
                     max(before, default=None), sum(upto), sum(before)))
    assert rows(got, "k", "at", "t", "v", "l", "l_before", "m", "m_before", "s", "s_before") == sorted(
        want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def test_running_keeps_rows_without_key_or_order(spark):
    df = spark.createDataFrame([(None, 1, 2), ("a", None, 3), ("a", 1, 4)], "k string, at long, v long")
    got = running(df, ["k"], "at", last={"l": F.col("v")}, sums={"s": F.col("v")})
    assert {r["v"] for r in got.collect()} == {2, 3, 4}


def made_lines(rng, quotes=6, per_quote=5):
    out = []
    for q in range(quotes):
        for i in range(rng.randint(0, per_quote) if q else 12):
            kind = rng.choice(["Item", "Item", "Processing"])
            price = rng.choice([None, 0.0, 10.0, 99.5, -4.0])
            qty, pct = rng.choice([None, 0.0, 1.0, 3.0, 3.0]), rng.choice([None, 0.0, 12.5, 100.0, 130.0])
            out.append((q, f"l{i}", "c", "n", "d", kind, "x", rng.choice([7.0, -3.0, 0.1, None]), rng.choice([0.0, 2.0]),
                        rng.choice([True, False]) if kind == "Item" else False, price, qty, pct, rng.choice([0.0, 1.5]), rng.choice([None, 7.0, 20.5])))
    return out


def made_edits(rng, n, quotes=6):
    out = []
    for s in rng.sample(range(3 * n), n):
        kind = rng.choices(["qty", "pct", "amt", "remove"], [4, 3, 3, 0.12])[0]
        out.append((rng.choice([0, 0, 0, *range(quotes + 1)]), f"l{rng.randint(0, 12)}", s, kind,
                    None if kind == "remove" else rng.choice([0.0, 0.5, 3.0, 50.0, 100.0, 140.0, 1e4])))
    return out


def edit(line, kind, value):
    price, q, p, a, t = line
    if price is None or q is None or p is None:
        return line
    if kind == "qty":
        q = value
    gross = price * q
    if kind == "amt":
        p, a = (value / gross * 100.0 if gross > 0 else 0.0), value
    else:
        p = value if kind == "pct" else p
        a = gross * (p / 100.0)
    if gross - a < 0:
        p, a = 100.0, gross
    return price, q, p, a, gross - a


@pytest.mark.parametrize("ranges", RANGES)
def test_edits_and_surcharge_changes_one_by_one(spark, store, ranges):
    rng = random.Random(ranges[0])
    lines, edits = made_lines(rng), made_edits(rng, 400)
    items = {"low": 1.0, "high": 2.5, "minus": -1.0, "none": None}
    services = {"s": 3.0, "t": -2.0}
    changes = [(q, s, rng.choice(["low", "high", "minus", "none", "unknown", "", None]), rng.choice(["s", "t", "s", "t", ""]))
               for q in range(6) for s in rng.sample(range(1200), 60 if q == 0 else 4)]
    quotes = [(q, 1, "low", "s", 1) for q in range(6)]
    cart = spark.createDataFrame(lines, CART)
    got = d.replay_with_surcharges(
        cart, spark.createDataFrame(edits, EDITS),
        spark.createDataFrame(changes, "quote_id long, seq long, item_surcharge string, service_surcharge string"),
        spark.createDataFrame(quotes, QUOTES),
        spark.createDataFrame([(1, k, v, i) for i, (k, v) in enumerate(items.items())], MULTIPLIERS),
        spark.createDataFrame([(1, k, v, i) for i, (k, v) in enumerate(services.items())], MULTIPLIERS), store, ranges)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    state = {(x[0], x[1]): (x, tuple(x[10:15])) for x in lines}
    log = [(s, 0, q, (c, k, v)) for q, c, s, k, v in edits] + [(s, 1, q, (i, p)) for q, s, i, p in changes]
    for _, change, q, what in sorted(log, key=lambda e: e[:3]):
        if not change:
            c, kind, value = what
            if (q, c) in state:
                if kind == "remove":
                    del state[q, c]
                else:
                    fixed, line = state[q, c]
                    state[q, c] = fixed, edit(line, kind, value)
        elif what[0] in items and what[1] in services:
            for key, (x, (_, n, p, _, _)) in list(state.items()):
                if key[0] == q:
                    m = items[what[0]] if x[5] == "Item" else services[what[1]]
                    if x[5] == "Item" and x[9]:
                        price = None if x[7] is None else x[7] + x[8]
                    else:
                        price = None if x[7] is None or m is None else x[7] * m + (x[8] if x[5] == "Item" else 0.0)
                        if x[5] != "Item" and price is not None:
                            price = x[7] * m
                    gross = None if price is None or n is None else price * n
                    a = None if gross is None or p is None else gross * (p / 100.0)
                    state[key] = x, (price, n, p, a, None if a is None else gross - a)
    want = [(*k, *line) for k, (_, line) in state.items()]
    assert rows(got, *SHOWN) == sorted(want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
    assert len(want) < len(lines) and store.n < 10


@pytest.mark.parametrize("ranges", RANGES)
def test_totals_after_every_event(spark, store, ranges):
    rng = random.Random(ranges[0] + 1)
    lines, edits = made_lines(rng), made_edits(rng, 300)
    quotes = [(q, 1, "low", "s" if q != 3 else "", q + 1) for q in range(6)]
    got = d.totals_after_events(spark.createDataFrame(lines, CART), spark.createDataFrame(edits, EDITS),
                                spark.createDataFrame(quotes, QUOTES), store, ranges)
    state = {(x[0], x[1]): tuple(x[10:15]) for x in lines}
    want = []
    for q, c, s, kind, value in sorted(edits, key=lambda e: (e[2], e[1])):
        if (q, c) in state:
            if kind == "remove":
                del state[q, c]
            else:
                state[q, c] = edit(state[q, c], kind, value)
        own = [t for (p, _), (*_, t) in state.items() if p == q]
        if q < 6:
            net = sum(round(t or 0.0, 6) for t in own)
            want.append((q, s, c, len(own), round(net, 4), round(net * (q + 1), 4)))
    shown = [(r["quote_id"], r["seq"], r["cart_id"], r["n_lines"], round(r["net_total"], 4), round(r["project_total"], 4)) for r in got.collect()]
    assert sorted(shown) == sorted(want)
    assert {r["text"] for r in got.where("quote_id = 3").collect()} <= {"Total (Per Batch): $0.00"}


def replayed(cart, item_picks, service_picks, removals):
    """Ids of the lines left, one request after the other."""
    live = [(x[0], x[1], x[2], x[3]) for x in cart]
    log = [(s, 0, q, c) for q, c, s in removals]
    for order, picks in ((1, item_picks), (2, service_picks)):
        for q, s in {(p[0], p[1]) for p in picks}:
            log.append((s, order, q, [p for p in picks if p[:2] == (q, s)]))
    for s, order, q, what in sorted(log, key=lambda e: e[:3]):
        own = [x for x in live if x[0] == q]
        if order == 0:
            live = [x for x in live if not (x[0] == q and x[1] == what)]
        elif order == 1:
            live += [(q, f"I-{s}-{ix}", code, name) for _, _, ix, code, name in what if code not in {x[2] for x in own}]
        else:
            live += [(q, f"P-{s}-{ix}", "SVC", name) for _, _, ix, name in what if name not in {x[3] for x in own}]
    return sorted((q, c) for q, c, _, _ in live)


@pytest.mark.parametrize("ranges, seed", [(RANGES[0], 0), (RANGES[2], 9)])
def test_additions_and_removals_one_by_one(spark, store, ranges, seed):
    rng = random.Random(seed)
    codes, names = [None, "a", "b", "c"], [None, "x", "y", "shared"]
    cart = [(q, f"l{i}", rng.choice(codes) if kind == "Item" else "SVC", rng.choice(names), "d", kind, "g", 1.0, 0.0, False, 0.0, 1.0, 0.0, 0.0, 0.0)
            for q in range(4) for i, kind in enumerate(rng.choices(["Item", "Processing"], k=rng.randint(0, 3)))]
    picks, services, removals, ids = [], [], [], {q: [f"l{i}" for i in range(3)] for q in range(5)}
    for s in range(400):
        q, what = rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.random()
        if what < 0.4:
            for ix in range(rng.choice([1, 1, 2, 3])):
                code = rng.choice(codes)
                picks.append((q, s, ix, code, rng.choice(names)))
                ids[q].append(f"I-{s}-{ix}")
        elif what < 0.6:
            for ix in range(rng.choice([1, 2])):
                services.append((q, s, ix, rng.choice(names)))
                ids[q].append(f"P-{s}-{ix}")
        else:
            for c in rng.sample(ids[q][-8:], min(len(ids[q]), rng.choice([1, 2, 4]), 8)):
                removals.append((q, c, s))
    got = cart_log.replay_cart_log(
        spark.createDataFrame(cart, CART),
        spark.createDataFrame([(*p, "c", "d", 2.0, 0.0, False) for p in picks],
                              "quote_id long, add_seq long, pick_ix long, product_code string, item string, category string, "
                              "description string, base_cost double, add_cost double, is_constant boolean"),
        spark.createDataFrame([(*p, "g", "d", 2.0) for p in services],
                              "quote_id long, add_seq long, pick_ix long, service string, grp string, description string, base_price double"),
        spark.createDataFrame(removals, "quote_id long, cart_id string, seq long"), store, ranges)
    want = replayed(cart, picks, services, removals)
    assert rows(got, "quote_id", "cart_id") == want
    assert any(c.startswith("I-") for _, c in want) and any(c.startswith("P-") for _, c in want)


def test_an_alternating_code_takes_few_rounds(spark, store):
    """One code is added and removed 300 times; every second addition finds it in the cart."""
    picks = [(1, s, 1, "a", "x", "c", "d", 2.0, 0.0, False) for s in range(0, 1800, 3)]
    removals = [(1, f"I-{s}-1", s + 4) for s in range(0, 1800, 6)]
    got = cart_log.replay_cart_log(
        spark.createDataFrame([], CART),
        spark.createDataFrame(picks, "quote_id long, add_seq long, pick_ix long, product_code string, item string, category string, "
                                     "description string, base_cost double, add_cost double, is_constant boolean"),
        spark.createDataFrame([], "quote_id long, add_seq long, pick_ix long, service string, grp string, description string, base_price double"),
        spark.createDataFrame(removals, "quote_id long, cart_id string, seq long"), store, (64, 512))
    assert rows(got, "quote_id", "cart_id") == [] == replayed([], [p[:5] for p in picks], [], removals)
    assert store.n < 40
