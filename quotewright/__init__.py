"""Quoting and pricing in bulk on Spark DataFrames."""

from quotewright.operators.cart import add_items, add_services, remove_lines, reprice
from quotewright.operators.cart_log import replay_cart_log
from quotewright.operators.catalog import (
    label_names, price_items_by_label, price_items_long, price_items_wide, price_services_by_label,
    price_services_long, price_services_wide,
)
from quotewright.operators.discounts import (
    apply_edits, bulk_amount, bulk_percent, edit_amount, edit_percent, edit_quantity, replay_edits,
    replay_with_surcharges, resolve_edits, supplier_discount, totals_after_events,
)
from quotewright.operators.selection import (
    application_choices, choice_list, eligible_item_classes, eligible_item_counts, eligible_items,
    eligible_service_classes, eligible_service_counts, eligible_services, filter_items, filter_services, protocol_choices,
)
from quotewright.operators.surcharges import multiplier_reference, surcharge_labels, surcharge_rejects
from quotewright.operators.totals import (
    batch_totals, grand_total_text, invoice_lines, invoice_totals, quote_header, quote_lines,
    quote_totals, quote_view,
)
from quotewright.operators.what_if import totals_by_label
from quotewright.schemas import PriceBook
from quotewright.session import tune
from quotewright.sources.carts import load_cart, replay_stored, reprice_stored, store_cart
from quotewright.sources.refresh import refresh_quotes, refreshed_lines, refreshed_totals
from quotewright.sources.sinks import write_quote_lines, write_quote_totals
from quotewright.sources.tables import (
    load_price_book, price_book, read_price_book, write_price_book,
)
from quotewright.sources.uploads import publish, published_book
from quotewright.sources.workbooks import (
    ingest_workbooks, stage_workbooks, workbook_rejects, workbook_sheets,
)
from quotewright.streaming.edits import (
    apply_summaries, current_lines, run_to_table, stream_edits, stream_summaries,
)
from quotewright.streaming.totals import begin_totals, followed_totals, stream_totals
from quotewright.streaming.versions import stream_versions, versioned_lines

__all__ = [
    "PriceBook", "add_items", "add_services", "application_choices", "apply_edits", "apply_summaries",
    "batch_totals", "begin_totals", "bulk_amount", "bulk_percent", "choice_list", "current_lines", "edit_amount",
    "edit_percent", "edit_quantity", "eligible_item_classes", "eligible_item_counts", "eligible_items",
    "eligible_service_classes", "eligible_service_counts", "eligible_services", "filter_items", "filter_services", "followed_totals",
    "grand_total_text", "ingest_workbooks", "invoice_lines", "invoice_totals", "load_cart", "load_price_book",
    "label_names", "multiplier_reference", "price_book", "price_items_by_label", "price_items_long",
    "price_items_wide", "price_services_by_label", "price_services_long", "price_services_wide", "protocol_choices", "publish", "published_book", "quote_header", "quote_lines",
    "quote_totals", "quote_view", "read_price_book", "refresh_quotes", "refreshed_lines", "refreshed_totals", "remove_lines", "replay_cart_log", "replay_edits", "replay_stored", "replay_with_surcharges",
    "reprice", "reprice_stored",
    "resolve_edits", "run_to_table", "stage_workbooks", "store_cart", "stream_edits", "stream_summaries", "stream_totals", "stream_versions", "supplier_discount",
    "surcharge_labels", "surcharge_rejects", "totals_after_events", "totals_by_label", "tune", "versioned_lines", "workbook_rejects", "workbook_sheets",
    "write_price_book", "write_quote_lines", "write_quote_totals",
]
