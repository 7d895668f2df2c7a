import datetime as dt
import io
import os
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_catalog_cart import line

from quotewright.schemas import CART, SHEETS
from quotewright.sources import sinks
from quotewright.sources.tables import (
    counts, load_price_book, price_book, read_price_book, read_sheet, write_price_book,
)
from quotewright.sources.workbooks import (
    ingest_workbooks, pack_workbooks, stage_workbooks, workbook_bytes, workbook_rejects, workbook_sheet, workbook_sheets,
)

PRICES = [
    ["Product_Code", "Brand", "Item", "Category", "Description", "Base_Cost", "Add_Cost", "Is_Constant",
     "Application", "Protocol"],
    ["x1", "B", " i & j ", "k", "<d>", "10", None, "TRUE", "A1;A2", "p1"],
    ["x2", "B", "j", "k", None, "TBC", "1", "no", None, None],
]
SERVICES = [["Group", "Code", "Service", "Description", "Base_Price", "Protocol", "Application"],
            ["g", "c", "s", "d", "4.5", None, "A1"]]
SURCHARGES = [["Type", "Label", "Amount"], ["PRICE_LIST", "std", "1.5"], ["PROCESSING", "a", "2"],
              ["PROCESSING", "b", "3"]]
DISCOUNTS = [["Supplier", "Label", "Amount", "End_Date", "Type"], ["S", "L", "0.2", "45444", "Percentage"],
             ["S", "M", "5", "2020-01-01", "amount"]]
SHEETS_OF_TEXT = [PRICES, SERVICES, SURCHARGES, DISCOUNTS]
AS_OF = dt.date(2024, 6, 1)


def check(book):
    assert rows(book.items, "product_code", "item", "base_cost", "is_constant") == [("x1", "i & j", 10.0, True)]
    assert rows(book.services, "service", "base_price") == [("s", 4.5)]
    assert rows(book.service_multipliers, "label", "multiplier") == [("a", 2.0), ("b", 6.0)]
    assert rows(book.item_multipliers, "label", "multiplier") == [("std", 1.5)]
    assert rows(book.item_tags, "item", "application", "protocol") == [
        ("i & j", ["A1", "A2"], ["p1"]), ("j", ["ALL_APPLICATIONS"], ["ALL_PROTOCOLS"])]
    assert rows(book.service_tags, "application", "protocol") == [(["A1"], ["ALL_PROTOCOLS"])]
    assert rows(book.discounts, "display_text") == [("S | L | 20%",)]
    assert sum(r["n"] for r in counts(book).collect()) == 9


def test_workbooks(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    for name in ("a.xlsx", "deep/b.xlsx"):
        (tmp_path / "in" / name).write_bytes(workbook_bytes(SHEETS_OF_TEXT))
    (tmp_path / "in" / "broken.xlsx").write_bytes(b"no workbook")
    (tmp_path / "in" / "notes.txt").write_bytes(b"ignored")
    cells = ingest_workbooks(spark, str(tmp_path / "in"))
    assert [r["book_id"].rsplit("/", 1)[1] for r in workbook_rejects(cells).collect()] == ["broken.xlsx"]
    sheets = workbook_sheets(cells)
    assert {r["book_id"].rsplit("/", 1)[1] for r in sheets["prices"].collect()} == {"a.xlsx", "b.xlsx"}
    one_book = cells.where("book_id LIKE '%a.xlsx'")
    check(price_book({s: workbook_sheet(one_book, s) for s in SHEETS}, AS_OF))


def damaged(sheets, name, change):
    """A workbook with one of its parts changed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook_bytes(sheets))) as old, zipfile.ZipFile(out, "w") as new:
        for part in old.namelist():
            new.writestr(part, change(old.read(part)) if part.endswith(name) else old.read(part))
    return out.getvalue()


def test_workbooks_are_read_whole_or_not_at_all(spark, tmp_path):
    whole = workbook_bytes(SHEETS_OF_TEXT)
    (tmp_path / "whole.xlsx").write_bytes(whole)
    (tmp_path / "sheet3.xlsx").write_bytes(damaged(SHEETS_OF_TEXT, "sheet3.xml", lambda x: x[:len(x) // 2]))
    (tmp_path / "cut.xlsx").write_bytes(whole[:len(whole) // 2])
    cells = ingest_workbooks(spark, str(tmp_path))
    name = F.element_at(F.split("book_id", "/"), -1).alias("name")
    assert rows(workbook_rejects(cells).select(name)) == [("cut.xlsx",), ("sheet3.xlsx",)]
    staged = stage_workbooks(cells, str(tmp_path / "staged"))
    assert rows(workbook_rejects(staged).select(name)) == [("cut.xlsx",), ("sheet3.xlsx",)]
    for sheet in SHEETS:
        assert rows(workbook_sheet(cells, sheet).select(name).distinct()) == [("whole.xlsx",)]
        assert rows(workbook_sheet(staged, sheet)) == rows(workbook_sheet(cells, sheet))
        plan = workbook_sheet(cells, sheet)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Join" not in plan
        plan = workbook_sheet(staged, sheet)._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "PartitionFilters: [isnotnull(sheet_ix" in plan


def test_packing_cuts_long_books(spark):
    data = [("b", 0, i, [str(i), None, f"t{i}"]) for i in range(1, 8)]
    cells = spark.createDataFrame(data, "book_id string, sheet_ix int, row_ix long, cells array<string>")
    files = pack_workbooks(cells, [["n", "e", "t"]], rows_per_workbook=3)
    assert rows(files, "path") == [("b-0",), ("b-1",), ("b-2",)]
    with pytest.raises(ValueError):
        pack_workbooks(cells, [["n"]], rows_per_workbook=2_000_000)


def test_csv_text_with_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('book_id,row_ix,Group,Code,Service,Description,Base_Price,Protocol,Application\n'
                                    'b,1,g,c,s,"two\nlines, ""quoted""",4.5,p,A\n')
    got = read_sheet(spark, str(tmp_path / "s.csv"), "services")
    assert rows(got, "description", "base_price", "application") == [('two\nlines, "quoted"', "4.5", "A")]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_price_book_from_files(spark, tmp_path, fmt):
    paths = {}
    for sheet, table in zip(SHEETS, SHEETS_OF_TEXT):
        paths[sheet] = str(tmp_path / sheet)
        header = ["book_id", "row_ix", *table[0]]
        schema = ", ".join(f"`{h}` {'long' if h == 'row_ix' else 'string'}" for h in header)
        df = spark.createDataFrame([("b", i, *r) for i, r in enumerate(table[1:])], schema)
        writer = df.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(paths[sheet])
    check(read_price_book(spark, paths, fmt, AS_OF))


def test_stored_price_book(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(SHEETS_OF_TEXT))
    write_price_book(price_book(workbook_sheets(ingest_workbooks(spark, path)), AS_OF), str(tmp_path / "book"))
    stored = load_price_book(spark, str(tmp_path / "book"))
    check(stored)
    text = stored.items.where("book_id = 'z'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(book_id,z)" in text


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sinks(spark, tmp_path, fmt):
    cart = spark.createDataFrame([line(1, "a", price=10.0, total=18.0, amt=2.0), line(2, "a", price=1.0)], CART)
    quotes = spark.createDataFrame([(1, "b", 2), (2, "c", 1), (3, "c", 1)],
                                   "quote_id long, book_id string, n_batches int")
    sinks.write_quote_lines(cart, quotes, str(tmp_path / "lines"), fmt)
    sinks.write_quote_totals(cart, quotes, str(tmp_path / "totals"), fmt)
    reader = spark.read.option("header", True).option("inferSchema", True).format(fmt)
    lines = reader.load(str(tmp_path / "lines"))
    assert rows(lines, "quote_id", "Amount", "`Total Amount [AUD]`", "book_id") == [
        (1, 10.0, 18.0, "b"), (2, 1.0, 0.0, "c")]
    assert rows(reader.load(str(tmp_path / "totals")), "quote_id", "net_total", "project_total") == [
        (1, 18.0, 36.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
