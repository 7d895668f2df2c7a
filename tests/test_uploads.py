"""Uploads of price books: versions, and what is cleaned again."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotewright.schemas import SHEETS, PriceBook
from quotewright.sources import uploads
from quotewright.sources.tables import price_book

DAY = dt.date(2024, 6, 1)
COLUMNS = {
    "prices": "product_code brand item category description base_cost add_cost is_constant application protocol",
    "services": "grp service description base_price application protocol",
    "surcharges": "type label amount", "discounts": "supplier label amount end_date type",
}
ROWS = {
    "prices": ("x", "B", "i", "k", None, "10", None, "yes", "A1;A2", "p"), "services": ("g", "s", "d", "4.5", "A1", None),
    "surcharges": ("PROCESSING", "std", "1.5"), "discounts": ("S", "L", "0.2", "2024-06-10", "percentage"),
}


def sheet(spark, name, books, **changed):
    """Two rows per book, the first with ``changed`` values."""
    names = COLUMNS[name].split()
    values = [dict(zip(names, ROWS[name])) for _ in range(2)]
    values[0] |= changed
    data = [(b, i, *[v[n] for n in names]) for b in books for i, v in enumerate(values)]
    return spark.createDataFrame(data, "book_id string, row_ix long, " + ", ".join(f"{n} string" for n in names))


def upload(spark, books, **changed):
    return {s: sheet(spark, s, books) for s in SHEETS} | changed


def same(got: PriceBook, want: PriceBook):
    for name in PriceBook.__dataclass_fields__:
        a, b = getattr(got, name), getattr(want, name)
        assert a.columns == b.columns
        text = [F.col(c).cast("string") for c in a.columns]
        assert sorted(map(repr, a.select(*text).collect())) == sorted(map(repr, b.select(*text).collect())), name


def stored_books(spark, store, table, version):
    return {r.book_id for r in spark.read.parquet(f"{store}/tables/{table}/stored={version}").collect()}


def test_only_changed_sheets_are_cleaned_again(spark, tmp_path):
    store, first = str(tmp_path), upload(spark, "abc")
    assert uploads.publish(spark, first, store, DAY) == 1
    same(uploads.published_book(spark, store), price_book(first, DAY))
    # The same rows in another order and partitioning are no change.
    shuffled = {s: df.orderBy(F.desc("row_ix")).repartition(5) for s, df in first.items()}
    assert uploads.publish(spark, shuffled, store, DAY) == 1
    new = sheet(spark, "prices", "b", base_cost="99")
    assert uploads.publish(spark, upload(spark, "b", prices=new), store, DAY) == 2
    assert stored_books(spark, store, "items", 2) == {"b"}
    assert stored_books(spark, store, "services", 2) == stored_books(spark, store, "discounts", 2) == set()
    want = upload(spark, "abc", prices=sheet(spark, "prices", "ac").unionByName(new))
    same(uploads.published_book(spark, store), price_book(want, DAY))
    same(uploads.published_book(spark, store, 1), price_book(first, DAY))


def test_an_upload_replaces_all_sheets_of_its_books(spark, tmp_path):
    store, first = str(tmp_path), upload(spark, "ab")
    uploads.publish(spark, first, store, DAY)
    less = upload(spark, "b", services=sheet(spark, "services", ""), prices=sheet(spark, "prices", "bn"))
    assert uploads.publish(spark, less, store, DAY) == 2
    want = {**upload(spark, "ab"), "prices": sheet(spark, "prices", "abn"), "services": sheet(spark, "services", "a")}
    same(uploads.published_book(spark, store), price_book(want, DAY))


def test_discounts_run_out_by_the_day(spark, tmp_path):
    store, sheets = str(tmp_path), upload(spark, "a")
    uploads.publish(spark, sheets, store, DAY)
    later = dt.date(2024, 7, 1)
    assert uploads.publish(spark, sheets, store, later) == 2
    assert stored_books(spark, store, "items", 2) == set()
    same(uploads.published_book(spark, store), price_book(sheets, later))
    assert uploads.published_book(spark, store).discounts.isEmpty()


def test_a_lost_upload_is_never_seen(spark, tmp_path, monkeypatch):
    store, first = str(tmp_path), upload(spark, "ab")
    with pytest.raises(ValueError, match="no version"):
        uploads.published_book(spark, store)
    uploads.publish(spark, first, store, DAY)
    new = upload(spark, "a", prices=sheet(spark, "prices", "a", base_cost="77"))

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(uploads, "mark_done", lost)
        with pytest.raises(OSError):
            uploads.publish(spark, new, store, DAY)
    same(uploads.published_book(spark, store), price_book(first, DAY))
    with pytest.raises(ValueError, match="no version 2"):
        uploads.published_book(spark, store, 2)
    other = upload(spark, "b", prices=sheet(spark, "prices", "b", base_cost="55"))
    assert uploads.publish(spark, other, store, DAY) == 2  # replaces what the lost one began
    want = upload(spark, "ab", prices=sheet(spark, "prices", "a").unionByName(sheet(spark, "prices", "b", base_cost="55")))
    same(uploads.published_book(spark, store), price_book(want, DAY))


def test_digests(spark):
    base = upload(spark, "ab")
    digests = {(r.book_id, r.sheet): r.digest for r in uploads.sheet_digests(base, DAY).collect()}
    assert len(digests) == 8
    for change in ({"base_cost": "11"}, {"base_cost": None}, {"description": ""}):
        other = {**base, "prices": sheet(spark, "prices", "b", **change).unionByName(sheet(spark, "prices", "a"))}
        got = {(r.book_id, r.sheet): r.digest for r in uploads.sheet_digests(other, DAY).collect()}
        assert {k for k in digests if digests[k] != got[k]} == {("b", "prices")}
    twice = {**base, "prices": base["prices"].unionByName(base["prices"])}
    got = {(r.book_id, r.sheet): r.digest for r in uploads.sheet_digests(twice, DAY).collect()}
    assert {k for k in digests if digests[k] != got[k]} == {("a", "prices"), ("b", "prices")}
    nobody = {s: df.withColumn("book_id", F.lit(None).cast("string")) for s, df in base.items()}
    assert uploads.sheet_digests(nobody, DAY).isEmpty()
    plan = uploads.sheet_digests(base, DAY)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan.replace("PythonRDD", "").replace("applySchemaToPythonRDD", "")
