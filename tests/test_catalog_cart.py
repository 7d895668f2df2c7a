import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotewright.operators import cart as carts
from quotewright.functions.values import total
from quotewright.operators import catalog, totals
from quotewright.operators.surcharges import multiplier_reference, surcharge_rejects
from quotewright.schemas import CART

ITEMS = ("book_id string, product_code string, brand string, item string, category string, "
         "description string, base_cost double, add_cost double, is_constant boolean")
MULTIPLIERS = "book_id string, label string, multiplier double, label_ix int"


def line(quote, cart, kind="Item", base=100.0, add=5.0, constant=False, price=0.0, qty=2.0,
         pct=10.0, amt=0.0, total=0.0, code=None, name=None, description="d"):
    return (quote, cart, code or f"c{cart}", name or f"n{cart}", description, kind, "cat", base,
            add, constant, price, qty, pct, amt, total)


@pytest.fixture(scope="module")
def item_mults(spark):
    return spark.createDataFrame([("b", "std", 1.5, 0), ("b", "hole", None, 1), ("c", "low", 0.5, 0)],
                                 MULTIPLIERS)


@pytest.fixture(scope="module")
def service_mults(spark):
    return spark.createDataFrame([("b", "svc", 2.0, 0)], MULTIPLIERS)


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame(
        [(1, "b", "std", "svc", 3), (2, "b", "", "svc", 1), (3, "b", "gone", "svc", 2),
         (4, "b", "hole", "svc", 1), (5, "b", "std", None, 1)],
        "quote_id long, book_id string, item_surcharge string, service_surcharge string, n_batches int")


def test_catalog_prices(spark, item_mults):
    items = spark.createDataFrame(
        [("b", "x", "B", "i", "k", "d", 100.0, 5.0, False), ("b", "y", "B", "j", "k", "d", 100.0, 5.0, True),
         ("c", "z", "B", "k", "k", "d", 100.0, 5.0, False), ("e", "w", "B", "k", "k", "d", 1.0, 0.0, True)],
        ITEMS)
    assert rows(catalog.price_items_long(items, item_mults), "product_code", "label", "price") == [
        ("x", "hole", None), ("x", "std", 155.0), ("y", "hole", 105.0), ("y", "std", 105.0),
        ("z", "low", 55.0)]
    wide = catalog.price_items_wide(items, item_mults, catalog.label_names(item_mults))
    assert wide.columns == ["book_id", "code", "brand", "item", "description", "low", "std", "hole"]
    assert rows(wide, "code", "std", "hole", "low") == [
        ("w", None, None, None), ("x", 155.0, None, None), ("y", 105.0, 105.0, None),
        ("z", None, None, 55.0)]


def test_many_books_with_labels_of_their_own(spark):
    books = 1500
    mults = spark.range(books).selectExpr(
        "concat('b', id) AS book_id", "concat('label ', id) AS label", "2.0D AS multiplier", "id AS label_ix")
    items = spark.range(books).selectExpr(
        "concat('b', id) AS book_id", "concat('p', id) AS product_code", "'x' AS brand", "'i' AS item", "'c' AS category",
        "'d' AS description", "10.0D AS base_cost", "1.0D AS add_cost", "false AS is_constant")
    got = catalog.price_items_by_label(items, mults.where("label_ix > 0")).collect()
    assert len(got) == books
    for r in got:
        n = r["book_id"][1:]
        assert [tuple(p) for p in r["prices"]] == ([] if n == "0" else [(f"label {n}", 21.0)])


def test_prices_by_label_keep_the_order_of_the_sheet(spark, service_mults):
    services = spark.createDataFrame([("b", "g", "s", "d", 40.0), ("none", "g", "t", "d", 1.0)],
                                     "book_id string, grp string, service string, description string, "
                                     "base_price double")
    got = {r["service"]: r["prices"] for r in catalog.price_services_by_label(services, service_mults).collect()}
    assert [tuple(p) for p in got["s"]] == [("svc", 80.0)] and got["t"] == []


def test_totals_of_any_size(spark):
    """Large amounts neither end the job nor go missing, and small ones add up exactly."""
    values = [(1, 0.1)] * 30 + [(2, 1e12), (2, 0.25), (3, 1e20), (3, 1e20), (4, 1e300), (4, 1.0), (5, None),
                                (6, float("nan")), (6, 2.0), (7, -1e12), (7, 1e12), (7, 0.5)]
    df = spark.createDataFrame(values, "k int, v double").groupBy("k").agg(total(F.col("v")).alias("t"))
    assert rows(df) == [(1, 3.0), (2, 1e12 + 0.25), (3, 2e20), (4, 1e300), (5, 0.0), (6, 2.0), (7, 0.5)]


def test_service_prices(spark, service_mults):
    services = spark.createDataFrame([("b", "g", "s", "d", 40.0)],
                                     "book_id string, grp string, service string, description string, "
                                     "base_price double")
    assert rows(catalog.price_services_long(services, service_mults), "service", "price") == [("s", 80.0)]
    assert rows(catalog.price_services_wide(services, service_mults, ["svc"]), "service", "svc") == [("s", 80.0)]
    assert catalog.price_services_wide(services, service_mults, []).columns == [
        "book_id", "grp", "service", "description"]


def test_reprice(spark, quotes, item_mults, service_mults):
    cart = spark.createDataFrame(
        [line(1, "a"), line(1, "b", constant=True), line(1, "c", constant=None),
         line(1, "d", kind="Processing"), line(1, "e", kind="Other"), line(1, "f", pct=150.0),
         line(2, "a", price=7.0, total=7.0), line(3, "a", price=7.0), line(4, "a"), line(9, "a", price=1.0)],
        CART)
    got = carts.reprice(cart, quotes, item_mults, service_mults)
    assert got.schema.names == CART.names
    assert rows(got, "quote_id", "cart_id", "unit_price", "disc_amt", "final_total") == [
        (1, "a", 155.0, 31.0, 279.0), (1, "b", 105.0, 21.0, 189.0), (1, "c", 0.0, 0.0, 0.0),
        (1, "d", 200.0, 40.0, 360.0), (1, "e", 0.0, 0.0, 0.0), (1, "f", 155.0, 465.0, -155.0),
        (2, "a", 7.0, 0.0, 7.0), (3, "a", 7.0, 0.0, 0.0), (4, "a", None, None, None),
        (9, "a", 1.0, 0.0, 0.0)]
    again = carts.reprice(got, quotes, item_mults, service_mults)
    assert rows(again) == rows(got)


def test_surcharge_reference_and_rejects(quotes, item_mults, service_mults):
    assert rows(multiplier_reference(quotes, item_mults, service_mults)) == [
        (1, 1, "Items (Consumables)", "x1.5"), (1, 2, "Processing Services", "x2"),
        (4, 1, "Items (Consumables)", "xNA"), (4, 2, "Processing Services", "x2")]
    assert rows(surcharge_rejects(quotes, item_mults, service_mults), "quote_id") == [(3,)]


def test_add_items(spark):
    cart = spark.createDataFrame([line(1, "x", code="A"), line(2, "y", code="B")], CART)
    picks = spark.createDataFrame(
        [(1, 7, 1, "A", "i", "d", "k", 3.0, 1.0, True), (1, 7, 2, "B", "j", "d", "k", 3.0, 1.0, True),
         (1, 7, 3, "B", "j", "d", "k", 3.0, 1.0, True), (2, 7, 1, None, "n", "d", "k", 3.0, 1.0, False)],
        "quote_id long, add_seq int, pick_ix int, product_code string, item string, description string, "
        "category string, base_cost double, add_cost double, is_constant boolean")
    got = carts.add_items(cart, picks)
    assert rows(got, "quote_id", "cart_id", "product_code", "quantity", "unit_price") == [
        (1, "I-7-2", "B", 1.0, 0.0), (1, "I-7-3", "B", 1.0, 0.0), (1, "x", "A", 2.0, 0.0),
        (2, "I-7-1", None, 1.0, 0.0), (2, "y", "B", 2.0, 0.0)]
    # A missing code in the cart blocks a missing code in the picks.
    assert carts.add_items(got, picks.where("quote_id = 2").withColumn("add_seq", F.lit(8))).count() == 5


def test_add_services_checks_names_of_all_lines(spark):
    cart = spark.createDataFrame([line(1, "x", name="wash")], CART)
    picks = spark.createDataFrame(
        [(1, 2, 1, "wash", "d", "g", 9.0), (1, 2, 2, "dry", "d", "g", 9.0)],
        "quote_id long, add_seq int, pick_ix int, service string, description string, grp string, "
        "base_price double")
    added = carts.add_services(cart, picks).where("cart_id <> 'x'").first().asDict()
    assert added == dict(zip(CART.names, (1, "P-2-2", "SVC", "dry", "d", "Processing", "g", 9.0, 0.0,
                                          False, 0.0, 1.0, 0.0, 0.0, 0.0)))


def test_remove_lines(spark):
    cart = spark.createDataFrame([line(1, "x"), line(1, "y"), line(2, "x")], CART)
    assert rows(carts.remove_lines(cart, F.col("cart_id") == "none")) == rows(cart)
    gone = spark.createDataFrame([(1, "x"), (1, "x"), (3, "x")], "quote_id long, cart_id string")
    assert rows(carts.remove_lines(cart, gone), "quote_id", "cart_id") == [(1, "y"), (2, "x")]


def test_totals_and_outputs(spark, quotes):
    cart = spark.createDataFrame(
        [line(1, "a", price=10.0, qty=2.0, amt=5.0, total=15.0, description=None),
         line(1, "b", price=None, qty=2.0, amt=None, total=None),
         line(2, "a", price=1000.5, qty=1.0, amt=0.0, total=1000.5)], CART)
    assert rows(totals.quote_totals(cart, quotes)) == [
        (1, 20.0, 5.0, 15.0, 3, 45.0, "batches"), (2, 1000.5, 0.0, 1000.5, 1, 1000.5, "batch"),
        (3, 0.0, 0.0, 0.0, 2, 0.0, "batches"), (4, 0.0, 0.0, 0.0, 1, 0.0, "batch"),
        (5, 0.0, 0.0, 0.0, 1, 0.0, "batch")]
    stale = cart.withColumn("final_total", F.lit(None).cast("double"))
    assert rows(totals.invoice_totals(stale, quotes), "quote_id", "net_total")[0] == (1, 15.0)
    assert dict(rows(totals.grand_total_text(cart, quotes))) == {
        1: "Total (Per Batch): $15.00 | Total Project (3 batches): $45.00",
        **{q: "Total (Per Batch): $0.00" for q in (2, 3, 4, 5)}}
    big = cart.withColumns({"quote_id": F.lit(1).cast("long"), "final_total": F.lit(411.5)})
    assert rows(totals.grand_total_text(big, quotes), "text")[-1] == (
        "Total (Per Batch): $1,234.50 | Total Project (3 batches): $3,703.50",)
    view = totals.quote_view(cart, quotes)
    assert view.columns[2:] == ["Code", "Name", "Description", "Type", "Unit Price", "Quantity",
                                "Discount %", "Discount $", "Total"]
    assert rows(view, "quote_id", "cart_id") == [(1, "a"), (1, "b")]
    assert rows(totals.invoice_lines(cart), "quote_id", "cart_id", "Amount", "Description",
                "Total Amount [AUD]") == [
        (1, "a", "$10.00", "", "$15.00"), (1, "b", "$NA", "d", "$NA"),
        (2, "a", "$1000.50", "d", "$1000.50")]


def test_quote_header_pairs_by_name(spark):
    quote = spark.createDataFrame(
        [(9, "T", "2024-01-02", "P1", None, 4, 2, 2, 500)],
        "quote_id long, title string, date string, project_id string, platform string, n_samples int, "
        "n_batches int, samples_per_batch int, aimed_cells int")
    assert [r[2:] for r in rows(totals.quote_header(quote), "quote_id", "ord", "label", "value")] == [
        ("Title", "T"), ("Date:", "2024-01-02"), ("Quote ID:", "9"), ("Project ID:", "P1"),
        ("Project Title:", "T"), ("Platform:", ""), ("Total # samples:", "4"), ("# batches:", "2"),
        ("# samples per batch:", "2"), ("Aimed # cells per sample:", "500")]
