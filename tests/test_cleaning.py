import datetime as dt
import itertools
import operator

from conftest import rows
from pyspark.sql import functions as F

from quotewright.operators.cleaning import (
    clean_discounts, discount_rejects, clean_items, clean_services, item_rejects, positional,
)
from quotewright.operators.surcharges import (
    item_multipliers, service_multipliers, surcharge_labels,
)
from quotewright.operators.tagging import item_tags, service_tags

ITEMS = ("book_id string, row_ix long, product_code string, brand string, item string, "
         "category string, description string, base_cost string, add_cost string, "
         "is_constant string, application string, protocol string")


def item(ix, base="10", add=None, flag=None, app=None, proto=None):
    return ("b", ix, f"c{ix}", "B", f"i{ix}", "cat", "d", base, add, flag, app, proto)


def test_items_keep_only_usable_rows(spark):
    raw = spark.createDataFrame(
        [item(1, "10", None, "yes"), item(2, None), item(3, "TBC"), item(4, "5", "2.5", "no"),
         item(5, "5", "ask"), item(6, "oops", "ask")], ITEMS)
    assert rows(clean_items(raw), "row_ix", "base_cost", "add_cost", "is_constant") == [
        (1, 10.0, 0.0, True), (4, 5.0, 2.5, False)]
    assert rows(item_rejects(raw), "row_ix", "add_cost_text") == [(5, "ask")]


def test_empty_sheets_stay_empty(spark):
    raw = spark.createDataFrame([], ITEMS)
    assert clean_items(raw).count() == 0
    assert clean_items(raw).columns == ["book_id", "row_ix", "product_code", "brand", "item",
                                        "category", "description", "base_cost", "add_cost",
                                        "is_constant"]
    assert item_tags(raw).count() == 0
    surcharges = spark.createDataFrame(
        [], "book_id string, row_ix long, type string, label string, amount string")
    assert item_multipliers(surcharges).count() == service_multipliers(surcharges).count() == 0


def test_services(spark):
    raw = spark.createDataFrame(
        [("b", 1, "g", "s1", "d", "4.5", None, "p;q"), ("b", 2, "g", "s2", "d", "n/a", "x", None)],
        "book_id string, row_ix long, grp string, service string, description string, "
        "base_price string, application string, protocol string")
    assert rows(clean_services(raw), "service", "base_price") == [("s1", 4.5)]
    assert rows(service_tags(raw), "service", "application", "protocol") == [
        ("s1", ["ALL_APPLICATIONS"], ["p", "q"]), ("s2", ["x"], ["ALL_PROTOCOLS"])]


def test_tags_come_from_raw_rows(spark):
    raw = spark.createDataFrame([item(1, None, app="A;", proto=None)], ITEMS)
    assert rows(item_tags(raw), "item", "application", "protocol") == [
        ("i1", ["A"], ["ALL_PROTOCOLS"])]


def test_discounts(spark):
    def row(ix, amount, end, kind, supplier="S", label="L"):
        return ("b", ix, supplier, label, amount, end, kind)

    raw = spark.createDataFrame([
        row(1, "0.15", "2024-06-01", "Percentage"), row(2, "40", None, "AMOUNT", None, None),
        row(3, "0", "2030-01-01", "amount"), row(4, None, None, "amount"), row(5, "5", None, None),
        row(6, "5", "2024-05-31", "amount"), row(7, "0.07", "45444", "percentage"),
        row(8, "3", "2024/06/02", "other"), row(9, "3", "45443", "amount"),
    ], "book_id string, row_ix long, supplier string, label string, amount string, "
       "end_date string, type string")
    got = clean_discounts(raw, dt.date(2024, 6, 1))
    assert rows(got, "row_ix", "type", "display_text") == [
        (1, "percentage", "S | L | 15%"), (2, "amount", "NA | NA | $40"),
        (7, "percentage", "S | L | 7%"), (8, "other", "S | L | $3")]
    assert "end_date" not in got.columns
    # Without a date the discounts of today count: all dated ones are over.
    assert rows(clean_discounts(raw), "row_ix") == [(2,)]


def test_end_dates_are_read_or_rejected(spark):
    ends = ["2020-01-01 00:00:00", "2020-01-01T00:00:00", "2020-1-5", "2020/1/5 noon", "31/12/2020", "20200101",
            "soon", "2020-02-31", "2030-02-01 00:00", "2030-1-1", None, "47848", "2020-01-011"]
    raw = spark.createDataFrame(
        [("b", i, "S", "L", "5", e, "amount") for i, e in enumerate(ends)]
        + [("b", 20, "S", "L", "much", None, "amount"), ("b", 21, "S", "L", "1e300", None, "amount"),
           ("b", 22, "S", "L", "1e18", None, "percentage")],
        "book_id string, row_ix long, supplier string, label string, amount string, end_date string, type string")
    active = clean_discounts(raw, dt.date(2026, 1, 1))
    assert [r[0] for r in rows(active, "row_ix")] == [8, 9, 10, 11, 21, 22]
    assert rows(discount_rejects(raw), "row_ix", "reason") == [
        *((i, "end_date is not a date") for i in (4, 5, 6, 7, 12)), (20, "amount is not a number")]
    # One absurd amount does not keep the other rows from being shown.
    texts = {r["row_ix"]: r["display_text"] for r in active.collect()}
    assert texts[8] == "S | L | $5" and texts[21] == "S | L | $1.0E300" and texts[22] == "S | L | 1" + "0" * 20 + "%"


def surcharges(spark, *data):
    return spark.createDataFrame(
        [("b", i, kind, label, amount) for i, (kind, label, amount) in enumerate(data)],
        "book_id string, row_ix long, type string, label string, amount double")


def test_item_multipliers_last_amount_first_place(spark):
    raw = surcharges(spark, ("PRICE_LIST", "a", 1.0), ("PROCESSING", "a", 9.0),
                     ("PRICE_LIST", "b", 2.0), ("PRICE_LIST", "a", None), ("other", "c", 1.0),
                     ("PRICE_LIST", None, 3.0), ("PRICE_LIST", "", 3.0))
    got = item_multipliers(raw)
    assert rows(got, "label", "multiplier", "label_ix") == [("a", None, 0), ("b", 2.0, 2)]
    assert [r["label"] for r in surcharge_labels(got).collect()] == ["a", "b"]


def test_service_multipliers_stack(spark):
    def stacked(*amounts):
        raw = surcharges(spark, *[("PROCESSING", f"l{i}", a) for i, a in enumerate(amounts)])
        return [r[1] for r in rows(service_multipliers(raw), "label", "multiplier")]

    assert stacked(1.0, 1.2, 1.5) == [1.0, 1.2, 1.2 * 1.5]
    assert stacked(2.0, None, 3.0) == [2.0, None, None]
    assert stacked(0.0, -2.0) == [0.0, 0.0]
    assert stacked(2.0, 3.0, 0.5, 4.0, None, 2.0) == [2.0, 6.0, 3.0, 12.0, None, None]


def test_long_sheets_multiply_in_sheet_order(spark):
    """Bit by bit what multiplying one row after the other gives, gaps in the numbering included."""
    factors = [1 + ((i * 7919) % 101 - 50) / 10_000 for i in range(10_000)]
    raw = spark.createDataFrame(
        [("b", i * 3 + (1 << 33), "PROCESSING", f"l{i}", a) for i, a in enumerate(factors)],
        "book_id string, row_ix long, type string, label string, amount double")
    got = service_multipliers(raw).orderBy("label_ix").collect()
    want = list(itertools.accumulate(factors, operator.mul))
    assert [r["multiplier"] for r in got] == want and got[0]["label_ix"] == 1 << 33


def test_positional(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Code No.` int, b int, c int")
    assert positional(df, {"z": 2, "x": 0}).first().asDict() == {"z": 3, "x": 1}


def test_books_do_not_mix(spark):
    raw = surcharges(spark, ("PROCESSING", "a", 2.0), ("PROCESSING", "b", 3.0)).unionByName(
        surcharges(spark, ("PROCESSING", "a", 5.0)).withColumn("book_id", F.lit("other")))
    assert rows(service_multipliers(raw), "book_id", "label", "multiplier") == [
        ("b", "a", 2.0), ("b", "b", 6.0), ("other", "a", 5.0)]
