"""Table layouts and the fixed words of the price-book format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the format: these spellings occur in the input data.
ALL = "All"
ALL_APPLICATIONS = "ALL_APPLICATIONS"
ALL_PROTOCOLS = "ALL_PROTOCOLS"
PRICE_LIST = "PRICE_LIST"
PROCESSING = "PROCESSING"
TRUE_WORDS = ("TRUE", "T", "YES", "Y", "1")
TAG_SEPARATOR = ";"
ITEM_LINE = "Item"
SERVICE_LINE = "Processing"
SERVICE_CODE = "SVC"

BOOK = "book_id"
ROW = "row_ix"
LINE_KEY = ["quote_id", "cart_id"]

# Positions (from 0) of the columns that are read by position on each sheet.
SHEET_POSITIONS = {
    "prices": {
        "product_code": 0, "brand": 1, "item": 2, "category": 3, "description": 4,
        "base_cost": 5, "add_cost": 6, "is_constant": 7,
    },
    "services": {"grp": 0, "service": 2, "description": 3, "base_price": 4},
    "surcharges": {"type": 0, "label": 1, "amount": 2},
    "discounts": {"supplier": 0, "label": 1, "amount": 2, "end_date": 3, "type": 4},
}
# Columns found by their header instead.
SHEET_HEADERS = {
    "prices": {"application": "Application", "protocol": "Protocol"},
    "services": {"application": "Application", "protocol": "Protocol"},
    "surcharges": {},
    "discounts": {},
}
# Order of the sheets in a workbook.
SHEETS = ("prices", "services", "surcharges", "discounts")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _raw(*names: str) -> T.StructType:
    return T.StructType([
        T.StructField(BOOK, T.StringType()),
        T.StructField(ROW, T.LongType()),
        *_strings(*names),
    ])


# Raw sheets are read as text only; cleaning does every cast.
RAW_SCHEMAS = {
    "prices": _raw("Product_Code", "Brand", "Item", "Category", "Description", "Base_Cost",
                   "Add_Cost", "Is_Constant", "Application", "Protocol"),
    "services": _raw("Group", "Code", "Service", "Description", "Base_Price", "Application",
                     "Protocol"),
    "surcharges": _raw("Type", "Label", "Amount"),
    "discounts": _raw("Supplier", "Label", "Amount", "End_Date", "Type"),
}

CART = T.StructType([
    T.StructField("quote_id", T.LongType()),
    *_strings("cart_id", "product_code", "name", "description", "type", "category"),
    T.StructField("base_ref", T.DoubleType()),
    T.StructField("add_ref", T.DoubleType()),
    T.StructField("is_constant", T.BooleanType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("disc_pct", T.DoubleType()),
    T.StructField("disc_amt", T.DoubleType()),
    T.StructField("final_total", T.DoubleType()),
])

EDITS = T.StructType([
    T.StructField("quote_id", T.LongType()),
    T.StructField("cart_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("display_text", T.StringType()),
])

CELLS = T.StructType([
    T.StructField(BOOK, T.StringType()),
    T.StructField("sheet_ix", T.IntegerType()),
    T.StructField(ROW, T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    # The cells that the sheet's header names, in the order of SHEET_HEADERS.
    T.StructField("named", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class PriceBook:
    """The seven clean tables of any number of price books, keyed by ``book_id``."""

    items: DataFrame
    services: DataFrame
    item_multipliers: DataFrame
    service_multipliers: DataFrame
    item_tags: DataFrame
    service_tags: DataFrame
    discounts: DataFrame
