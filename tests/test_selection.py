import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotewright.operators import selection as sel

ITEMS = [("i1", "B1", "cat 1", 1550.0, 0.0, True), ("i2", "B2", "cat 1", 2250.0, 0.0, False),
         ("i3", "B2", "cat 2", 650.0, 45.0, False), ("i4", "B3", "cat 1", 2400.0, 0.0, False),
         ("i5", "B4", "cat 2", 7000.0, 200.0, False)]
ITEM_TAGS = [("i1", "B1", ["X"], ["X"]), ("i2", "B2", ["ALL_APPLICATIONS"], ["ALL_PROTOCOLS"]),
             ("i3", "B2", ["ALL_APPLICATIONS"], ["p1", "p2"]), ("i4", "B3", ["A1"], ["p3", "p4"]),
             ("i5", "B4", ["A2"], ["ALL_PROTOCOLS"])]
SERVICES = [("s1", "A", 4000.0), ("s2", "A", 5000.0), ("s3", "B", 1500.0), ("s4", "C", 2500.0),
            ("s5", "E", 3600.0), ("s6", "E", 7250.0)]
SERVICE_TAGS = [("s1", ["A1"], ["p3", "p4", "p5"]), ("s2", ["A1"], ["p3", "p4", "p5"]),
                ("s3", ["ALL_APPLICATIONS"], ["ALL_PROTOCOLS"]), ("s4", ["A3", "A2"], ["p6", "p7", "p1"]),
                ("s5", ["A3"], ["p7", "p1"]), ("s6", ["A2"], ["p6"])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("b", i, b, c, "per kit", x, y, z) for i, b, c, x, y, z in ITEMS],
        "book_id string, item string, brand string, category string, description string, "
        "base_cost double, add_cost double, is_constant boolean")


@pytest.fixture(scope="module")
def item_tags(spark):
    return spark.createDataFrame(
        [("b", b, i, a, p) for i, b, a, p in ITEM_TAGS],
        "book_id string, brand string, item string, application array<string>, protocol array<string>")


@pytest.fixture(scope="module")
def services(spark):
    return spark.createDataFrame([("b", g, s, "d", x) for s, g, x in SERVICES],
                                 "book_id string, grp string, service string, description string, "
                                 "base_price double")


@pytest.fixture(scope="module")
def service_tags(spark):
    return spark.createDataFrame(
        [("b", *t) for t in SERVICE_TAGS],
        "book_id string, service string, application array<string>, protocol array<string>")


@pytest.mark.parametrize("choice, n", [
    ({}, 5), ({"brand": "B2"}, 2), ({"category": "cat 1"}, 3), ({"application": "A1"}, 3),
    ({"protocol": "p3"}, 3), ({"application": "none"}, 2), ({"application": "X", "protocol": "p1"}, 2),
    ({"brand": "B4", "application": "A1"}, 0),
])
def test_filter_items(items, item_tags, choice, n):
    assert sel.filter_items(items, item_tags, **choice).count() == n


def test_filter_items_falls_back_to_everything(items, item_tags):
    strict = item_tags.where(~F.array_contains("application", "ALL_APPLICATIONS"))
    assert sel.filter_items(items, strict, application="none").count() == 5
    assert sel.filter_items(items, strict, application="none", brand="B2").count() == 2


def test_tags_of_unpriced_items_suppress_the_fallback(items, item_tags):
    """The whole tag table counts, not just the items that have a price."""
    assert sel.filter_items(items.where("item <> 'i4'"), item_tags.where("item in ('i1', 'i4')"),
                            application="A1").count() == 0


def test_null_names_match_null_names(spark, items, item_tags):
    unnamed = items.limit(1).withColumn("brand", F.lit(None).cast("string"))
    tags = item_tags.limit(1).withColumn("brand", F.lit(None).cast("string"))
    assert sel.filter_items(unnamed, tags.withColumn("item", F.lit("i1")), application="X").count() == 1


@pytest.mark.parametrize("choice, n", [
    ({}, 6), ({"group": "A"}, 2), ({"application": "A3"}, 3), ({"protocol": "p7"}, 3)])
def test_filter_services(services, service_tags, choice, n):
    assert sel.filter_services(services, service_tags, **choice).count() == n


def test_every_quote_at_once_equals_one_by_one(spark, items, item_tags, services, service_tags):
    """Two books, one of them without wildcards: rows and counts agree with single filters."""
    def both(df, strict=False):
        other = df.withColumn("book_id", F.lit("c"))
        if strict:
            other = other.where(~F.array_contains("application", "ALL_APPLICATIONS"))
        return df.unionByName(other)

    items2, tags2 = both(items), both(item_tags, strict=True)
    services2, stags2 = both(services), both(service_tags, strict=True)
    combos = [(b, a, p, br, c, g) for b in "bc" for a in ("All", "A1", "A2", "none")
              for p in ("All", "p1", "p3", "nope") for br, c, g in (("All", "All", "All"),
                                                                    ("B2", "All", "A"),
                                                                    ("All", "cat 1", "E"))]
    quotes = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(combos)] + [(1000, "b", "", "All", "All", "All", "All")],
        "quote_id long, book_id string, application string, protocol string, brand_filter string, "
        "category_filter string, group_filter string")
    n_items = dict(rows(sel.eligible_item_counts(quotes, items2, tags2)))
    n_services = dict(rows(sel.eligible_service_counts(quotes, services2, stags2)))
    listed = {}
    for q, i in rows(sel.eligible_items(quotes, items2, tags2), "quote_id", "item"):
        listed.setdefault(q, []).append(i)
    listed_services = {}
    for q, s in rows(sel.eligible_services(quotes, services2, stags2), "quote_id", "service"):
        listed_services.setdefault(q, []).append(s)
    assert n_items[1000] == n_services[1000] == 0

    def brute(catalog, tags, name, book, a, p, keep):
        rows_ = [t for t in tags if book == "b" or "ALL_APPLICATIONS" not in t[-2]]
        hits = {t[name] for t in rows_ if (a == "All" or {a, "ALL_APPLICATIONS"} & set(t[-2]))
                and (p == "All" or {p, "ALL_PROTOCOLS"} & set(t[-1]))}
        return sorted(c[0] for c in catalog if keep(c) and (not hits or c[0] in hits))

    for i, (b, a, p, br, c, g) in enumerate(combos):
        want = brute(ITEMS, ITEM_TAGS, 0, b, a, p,
                     lambda r: br in ("All", r[1]) and c in ("All", r[2]))
        assert listed.get(i, []) == want and n_items[i] == len(want)
        want = brute(SERVICES, SERVICE_TAGS, 0, b, a, p, lambda r: g in ("All", r[1]))
        assert listed_services.get(i, []) == want and n_services[i] == len(want)


def test_choices(items, item_tags, service_tags):
    assert [r["choice"] for r in sel.application_choices(item_tags, service_tags).collect()] == [
        "All", "A1", "A2", "A3", "X"]
    # Rows with the wildcard do not offer their protocols to a chosen application.
    assert [r["choice"] for r in sel.protocol_choices(item_tags, service_tags, "A2").collect()] == [
        "All", "p1", "p6", "p7"]
    assert [r["choice"] for r in sel.protocol_choices(item_tags, service_tags).collect()] == [
        "All", "X", "p1", "p2", "p3", "p4", "p5", "p6", "p7"]
    assert [r["choice"] for r in sel.choice_list(items, "brand").collect()] == ["All", "B1", "B2", "B3", "B4"]
    assert [r["choice"] for r in sel.choice_list(items, "category", "").collect()] == ["", "cat 1", "cat 2"]


def test_bitmaps_hold_many_rows_of_hot_names(spark):
    """One name with most rows and tags of a book; rows on both ends of a word and beyond it."""
    n = 700
    items = spark.createDataFrame(
        [(1, i, f"p{i}", "B" if i % 3 else None, "hot" if i % 10 else f"i{i}", "C" if i % 2 else "D") for i in range(n)],
        "book_id int, row_ix long, product_code string, brand string, item string, category string")
    tags = spark.createDataFrame(
        [(1, "B" if i % 3 else None, "hot" if i % 10 else f"i{i}", ["x", f"t{i % 4}"], ["P"] if i % 5 else ["ALL_PROTOCOLS"])
         for i in range(n)],
        "book_id int, brand string, item string, application array<string>, protocol array<string>")
    quotes = spark.createDataFrame(
        [(i, 1, a, p, b, c) for i, (a, p, b, c) in enumerate(
            (a, p, b, c) for a in ("x", "t1", "All", "none", None) for p in ("P", "All", "other") for b in ("All", "B", "Z", None)
            for c in ("All", "D"))],
        "quote_id long, book_id int, application string, protocol string, brand_filter string, category_filter string")
    got = sel.eligible_item_classes(quotes, items, tags)
    plain_items = [tuple(r) for r in items.collect()]
    plain_tags = [tuple(r) for r in tags.collect()]
    want = set()
    for q in {tuple(r)[2:] for r in quotes.collect()}:
        a, p, b, c = q
        if a is None:
            continue
        hits = {(t[1], t[2]) for t in plain_tags if (a == "All" or {a, "ALL_APPLICATIONS"} & set(t[3]))
                and (p == "All" or {p, "ALL_PROTOCOLS"} & set(t[4]))}
        want |= {(1, a, p, b, c, i[1]) for i in plain_items if (not hits or (i[3], i[4]) in hits)
                 and (b == "All" or b is not None and b == i[3]) and (c == "All" or c == i[5])}
    columns = ("book_id", "application", "protocol", "brand_filter", "category_filter", "row_ix")
    assert rows(got, *columns) == sorted(want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    counts = dict(rows(sel.eligible_item_counts(quotes, items, tags), "quote_id", "n_eligible"))
    for r in quotes.collect():
        assert counts[r["quote_id"]] == sum(w[:5] == tuple(r)[1:] for w in want)
