"""Plain SQL twins of the registered queries, for an independent SQL engine.

``STEPS`` are named subqueries in order; a query's text gets those it needs as CTEs.
"""

from __future__ import annotations

import re

from quotewright.functions.values import NUMBER_PATTERN
from quotewright.operators.cleaning import DATE_PATTERN, SERIAL_PATTERN
from quotewright.operators.totals import HEADER, QUOTE_LINES, QUOTE_VIEW
from quotewright.plans.views import VIEWS, view_sql

AS_OF = "DATE '1998-02-15'"


def number(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST({c} AS DOUBLE) END")


def plain(x: str) -> str:
    return f"rtrim(rtrim(CAST(CAST(round({x}, 10) AS DECIMAL(28,10)) AS VARCHAR), '0'), '.')"


def tags(c: str, wildcard: str) -> str:
    text = f"coalesce({c}, '{wildcard}')"
    body = f"CASE WHEN {text} LIKE '%;' THEN left({text}, length({text}) - 1) ELSE {text} END"
    return f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({body}, ';') END"


def display(supplier: str, label: str, amount: str, kind: str) -> str:
    return (f"coalesce({supplier}, 'NA') || ' | ' || coalesce({label}, 'NA') || ' | ' || "
            f"CASE WHEN {kind} = 'percentage' THEN {plain(f'{amount} * CAST(100 AS DOUBLE)')} || '%' "
            f"ELSE '$' || {plain(amount)} END")


def has(list_: str, selected: str, wildcard: str) -> str:
    return (f"({selected} = 'All' OR list_contains({list_}, {selected}) "
            f"OR list_contains({list_}, '{wildcard}'))")


def day(c: str) -> str:
    part = "lpad(regexp_extract({0}, '{1}', {2}), 2, '0')"
    y, m, d = (part.format(c, DATE_PATTERN, i) for i in (1, 2, 3))
    y = f"regexp_extract({c}, '{DATE_PATTERN}', 1)"
    return (f"CASE WHEN regexp_matches({c}, '{SERIAL_PATTERN}') "
            f"THEN DATE '1899-12-30' + CAST(floor(TRY_CAST({c} AS DOUBLE)) AS INTEGER) "
            f"WHEN regexp_matches({c}, '{DATE_PATTERN}') "
            f"THEN TRY_CAST({y} || '-' || {m} || '-' || {d} AS DATE) END")


def discounts(source: str) -> str:
    return f"""
SELECT *, {display('supplier', 'label', 'amount', 'type')} AS display_text
FROM (SELECT book_id, row_ix, supplier, label, amount, lower(type) AS type
      FROM (SELECT *, {day('end_date')} AS ends FROM {source})
      WHERE type IS NOT NULL AND amount > 0 AND (end_date IS NULL OR ends >= {AS_OF}))"""


def edited(kind: str, value: str) -> str:
    """SELECT list of one edit on a line ``l``; NULL kind leaves it alone."""
    return f"""quote_id, cart_id, unit_price,
  CASE WHEN k IS NULL THEN q0 ELSE q END AS quantity,
  CASE WHEN k IS NULL THEN p0 WHEN g - a < 0 THEN 100.0::DOUBLE ELSE p END AS disc_pct,
  CASE WHEN k IS NULL THEN a0 WHEN g - a < 0 THEN g ELSE a END AS disc_amt,
  CASE WHEN k IS NULL THEN t0 WHEN g - a < 0 THEN g - g ELSE g - a END AS final_total
FROM (SELECT *, CASE WHEN k = 'amt' THEN v ELSE g * (p / 100::DOUBLE) END AS a
  FROM (SELECT *, CASE k WHEN 'amt' THEN CASE WHEN g > 0 THEN v / g * 100::DOUBLE ELSE 0::DOUBLE END
                   WHEN 'pct' THEN v ELSE p0 END AS p
    FROM (SELECT *, unit_price * q AS g
      FROM (SELECT *, CASE WHEN k = 'qty' THEN v ELSE q0 END AS q
        FROM (SELECT l.quote_id, l.cart_id, l.unit_price, l.quantity AS q0, l.disc_pct AS p0,
                l.disc_amt AS a0, l.final_total AS t0,
                CASE WHEN l.unit_price IS NOT NULL THEN {kind} END AS k, {value} AS v"""


END_EDITED = ")))))"

STEPS: dict[str, str] = {name: view_sql(name) for name in VIEWS}
STEPS |= {
    "items_typed": f"""
SELECT book_id, row_ix, product_code, brand, item, category, description,
  {number('base_cost')} AS base_cost, {number('add_cost')} AS add_number, add_cost AS add_text,
  coalesce(upper(is_constant) IN ('TRUE', 'T', 'YES', 'Y', '1'), false) AS is_constant
FROM items_raw""",
    "items": """
SELECT book_id, row_ix, product_code, brand, item, category, description, base_cost,
  coalesce(add_number, 0::DOUBLE) AS add_cost, is_constant
FROM items_typed WHERE base_cost IS NOT NULL AND NOT (add_text IS NOT NULL AND add_number IS NULL)""",
    "services": f"""
SELECT * FROM (SELECT book_id, row_ix, grp, service, description, {number('base_price')} AS base_price
FROM services_raw) WHERE base_price IS NOT NULL""",
    "itags": f"""
SELECT book_id, brand, item, {tags('application', 'ALL_APPLICATIONS')} AS application,
  {tags('protocol', 'ALL_PROTOCOLS')} AS protocol FROM items_raw""",
    "stags": f"""
SELECT book_id, service, {tags('application', 'ALL_APPLICATIONS')} AS application,
  {tags('protocol', 'ALL_PROTOCOLS')} AS protocol FROM services_raw""",
    "picky_quotes": "SELECT * REPLACE ('nope' AS protocol) FROM quotes",
    "discounts": discounts("discounts_raw"),
    "imults": """
SELECT book_id, label, arg_max(struct_pack(a := amount), row_ix).a AS multiplier,
  min(row_ix) AS label_ix
FROM surcharges_raw WHERE type = 'PRICE_LIST' GROUP BY book_id, label""",
    "stacked": """
SELECT *, CASE WHEN max(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) OVER w = 0
  THEN product(amount) OVER w END AS cumulative
FROM surcharges_raw WHERE type = 'PROCESSING'
WINDOW w AS (PARTITION BY book_id ORDER BY row_ix ROWS UNBOUNDED PRECEDING)""",
    "smults": """
SELECT book_id, label, arg_max(struct_pack(a := cumulative), row_ix).a AS multiplier,
  min(row_ix) AS label_ix
FROM stacked GROUP BY book_id, label""",
    "params": """
SELECT quotes.*, im.multiplier AS item_mult, sm.multiplier AS service_mult,
  item_surcharge <> '' AND service_surcharge <> '' AS configured,
  item_surcharge <> '' AND service_surcharge <> '' AND im.label IS NOT NULL
    AND sm.label IS NOT NULL AS priceable
FROM quotes
LEFT JOIN imults im ON im.book_id = quotes.book_id AND im.label = item_surcharge
LEFT JOIN smults sm ON sm.book_id = quotes.book_id AND sm.label = service_surcharge""",
    "lines": """
SELECT quote_id, CAST(line_no AS VARCHAR) AS cart_id, product_code, item AS name, description,
  'Item' AS type, category, base_cost AS base_ref, add_cost AS add_ref, is_constant, status,
  0::DOUBLE AS unit_price, quantity, disc_pct, 0::DOUBLE AS disc_amt, 0::DOUBLE AS final_total
FROM cart_lines JOIN items ON row_ix = ref_ix WHERE type = 'Item'
UNION ALL
SELECT quote_id, CAST(line_no AS VARCHAR), 'SVC', service, description, 'Processing', grp,
  base_price, 0::DOUBLE, false, status, 0::DOUBLE, quantity, disc_pct, 0::DOUBLE, 0::DOUBLE
FROM cart_lines JOIN services ON row_ix = ref_ix WHERE type = 'Processing'""",
    "cart": "SELECT * EXCLUDE (status) FROM lines",
    "priced": """
SELECT * EXCLUDE (price, priceable, unit_price, disc_amt, final_total),
  CASE WHEN priceable THEN price ELSE unit_price END AS unit_price,
  CASE WHEN priceable THEN price * quantity * (disc_pct / 100::DOUBLE) ELSE disc_amt END AS disc_amt,
  CASE WHEN priceable THEN price * quantity - price * quantity * (disc_pct / 100::DOUBLE)
       ELSE final_total END AS final_total
FROM (
  SELECT lines.*, priceable,
    CASE WHEN type = 'Item' AND is_constant THEN base_ref + add_ref
         WHEN type = 'Item' THEN base_ref * item_mult + add_ref
         WHEN type = 'Processing' THEN base_ref * service_mult ELSE 0 END AS price
  FROM lines JOIN params USING (quote_id))""",
    "texts": """
SELECT book_id, display_text, min(amount) AS amount, min(type) AS type
FROM discounts GROUP BY book_id, display_text HAVING count(*) = 1""",
    "events_log": """
SELECT quote_id, cart_id, seq, op, value, display_text
FROM edit_events LEFT JOIN discounts ON discounts.row_ix = discount_ix""",
    "valid": """
SELECT quote_id, cart_id, seq, CASE op WHEN 'bulk_pct' THEN 'pct' WHEN 'bulk_amt' THEN 'amt'
  ELSE op END AS kind, value
FROM events_log
WHERE op IN ('qty', 'pct', 'amt', 'bulk_amt') AND value >= 0 OR op = 'bulk_pct' AND value BETWEEN 0 AND 100
  OR op = 'remove'
UNION ALL
SELECT quote_id, cart_id, seq, CASE type WHEN 'percentage' THEN 'pct' ELSE 'amt' END,
  CASE type WHEN 'percentage' THEN amount * 100::DOUBLE ELSE amount END
FROM events_log JOIN quotes USING (quote_id)
JOIN texts ON texts.book_id = quotes.book_id AND texts.display_text = events_log.display_text
WHERE op = 'supplier' AND type IN ('percentage', 'amount')""",
    "first_edits": """
SELECT quote_id, cart_id, arg_min(kind, seq) AS kind, arg_min(value, seq) AS value FROM valid GROUP BY quote_id, cart_id""",
    "numbered": """
SELECT *, row_number() OVER (PARTITION BY quote_id, cart_id ORDER BY seq) AS nth
FROM valid SEMI JOIN (SELECT quote_id, cart_id FROM priced WHERE unit_price IS NOT NULL) p
  USING (quote_id, cart_id)""",
    # One step per edit, in order.
    "walk": """
SELECT quote_id, cart_id, unit_price, quantity, disc_pct, disc_amt, final_total, CAST(0 AS BIGINT) AS nth
FROM priced
UNION ALL
SELECT quote_id, cart_id, unit_price, q,
  CASE WHEN g - a < 0 THEN 100::DOUBLE ELSE p END, CASE WHEN g - a < 0 THEN g ELSE a END,
  CASE WHEN g - a < 0 THEN g - g ELSE g - a END, nth
FROM (SELECT *, CASE WHEN kind = 'amt' THEN value ELSE g * (p / 100::DOUBLE) END AS a
  FROM (SELECT *, CASE kind WHEN 'amt' THEN CASE WHEN g > 0 THEN value / g * 100::DOUBLE ELSE 0::DOUBLE END
                       WHEN 'pct' THEN value ELSE disc_pct END AS p
    FROM (SELECT *, unit_price * q AS g
      FROM (SELECT w.quote_id, w.cart_id, w.unit_price, w.disc_pct, n.kind, n.value, n.nth,
              CASE WHEN n.kind = 'qty' THEN n.value ELSE w.quantity END AS q
            FROM walk w JOIN numbered n ON n.quote_id = w.quote_id AND n.cart_id = w.cart_id
              AND n.nth = w.nth + 1))))""",
    "replayed": """
SELECT quote_id, cart_id, unit_price, quantity, disc_pct, disc_amt, final_total
FROM (SELECT *, row_number() OVER (PARTITION BY quote_id, cart_id ORDER BY nth DESC) AS back FROM walk)
ANTI JOIN (SELECT quote_id, cart_id FROM valid WHERE kind = 'remove') r USING (quote_id, cart_id)
WHERE back = 1""",
}
# The same walk over the edits of one kind.
KINDS = {"qty": "edit_quantity", "pct": "edit_percent", "amt": "edit_amount"}
for kind in KINDS:
    STEPS[f"valid_{kind}"] = f"SELECT * FROM valid WHERE kind = '{kind}'"
    for step in ("numbered", "walk", "replayed"):
        STEPS[f"{step}_{kind}"] = re.sub(r"\b(valid|numbered|walk)\b", rf"\1_{kind}", STEPS[step])
# Edits and changes of surcharges together; no edit applies while a price is unknown.
STEPS["numbered_both"] = """
SELECT *, row_number() OVER (PARTITION BY quote_id, cart_id ORDER BY seq, kind = 'reprice') AS nth
FROM (SELECT quote_id, cart_id, seq, kind, value FROM valid
  UNION ALL
  SELECT quote_id, cart_id, seq, 'reprice', CASE WHEN type = 'Item' AND is_constant THEN base_ref + add_ref
      WHEN type = 'Item' THEN base_ref * im.multiplier + add_ref
      WHEN type = 'Processing' THEN base_ref * sm.multiplier ELSE 0 END
  FROM lines JOIN surcharge_changes c USING (quote_id) JOIN (SELECT quote_id, book_id FROM quotes) USING (quote_id)
  JOIN imults im ON im.book_id = quotes.book_id AND im.label = c.item_surcharge
  JOIN smults sm ON sm.book_id = quotes.book_id AND sm.label = c.service_surcharge)""".replace(
    "(SELECT quote_id, book_id FROM quotes) USING", "(SELECT quote_id, book_id FROM quotes) quotes USING")
STEPS["walk_both"] = """
SELECT quote_id, cart_id, unit_price, quantity, disc_pct, disc_amt, final_total, CAST(0 AS BIGINT) AS nth
FROM priced
UNION ALL
SELECT quote_id, cart_id, price, q,
  CASE WHEN same THEN p0 WHEN over THEN 100::DOUBLE ELSE p END, CASE WHEN same THEN a0 WHEN over THEN g ELSE a END,
  CASE WHEN same THEN t0 WHEN over THEN g - g ELSE g - a END, nth
FROM (SELECT *, kind <> 'reprice' AND coalesce(g - a < 0, false) AS over
FROM (SELECT *, CASE WHEN kind = 'amt' THEN value ELSE g * (p / 100::DOUBLE) END AS a
  FROM (SELECT *, CASE kind WHEN 'amt' THEN CASE WHEN g > 0 THEN value / g * 100::DOUBLE ELSE 0::DOUBLE END
                       WHEN 'pct' THEN value ELSE p0 END AS p
    FROM (SELECT *, price * q AS g
      FROM (SELECT w.quote_id, w.cart_id, w.disc_pct AS p0, w.disc_amt AS a0, w.final_total AS t0, n.kind, n.value, n.nth,
              n.kind <> 'reprice' AND w.unit_price IS NULL AS same,
              CASE WHEN n.kind = 'reprice' THEN n.value ELSE w.unit_price END AS price,
              CASE WHEN n.kind = 'qty' AND w.unit_price IS NOT NULL THEN n.value ELSE w.quantity END AS q
            FROM walk_both w JOIN numbered_both n ON n.quote_id = w.quote_id AND n.cart_id = w.cart_id
              AND n.nth = w.nth + 1)))))"""
STEPS["replayed_both"] = STEPS["replayed"].replace("FROM walk)", "FROM walk_both)")
# What each event does to the total and the number of lines of its quote.
STEPS["effects"] = """
SELECT e.quote_id, e.cart_id, e.seq, CASE WHEN gone OR p.quote_id IS NULL THEN 0 ELSE
    CASE WHEN e.kind = 'remove' THEN 0 ELSE coalesce(CAST(w.final_total AS DECIMAL(28,6)), 0) END
    - coalesce(CAST(b.final_total AS DECIMAL(28,6)), 0) END AS delta,
  CASE WHEN e.kind = 'remove' AND NOT gone AND p.quote_id IS NOT NULL THEN -1 ELSE 0 END AS fewer
FROM (SELECT *, coalesce(max(kind = 'remove') OVER (PARTITION BY quote_id, cart_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM valid) e
LEFT JOIN (SELECT quote_id, cart_id FROM priced) p USING (quote_id, cart_id)
LEFT JOIN numbered n USING (quote_id, cart_id, seq)
LEFT JOIN walk w ON w.quote_id = e.quote_id AND w.cart_id = e.cart_id AND w.nth = n.nth
LEFT JOIN walk b ON b.quote_id = e.quote_id AND b.cart_id = e.cart_id AND b.nth = n.nth - 1"""
STEPS["event_totals"] = """
SELECT quote_id, seq, cart_id, n_batches, item_surcharge, service_surcharge,
  coalesce(n_first, 0) + CAST(sum(fewer) OVER w AS BIGINT) AS n_lines,
  CAST(coalesce(first, 0) + sum(delta) OVER w AS DOUBLE) AS net_total
FROM effects JOIN quotes USING (quote_id)
LEFT JOIN (SELECT quote_id, count(*) AS n_first, sum(coalesce(CAST(final_total AS DECIMAL(28,6)), 0)) AS first
  FROM priced GROUP BY quote_id) f USING (quote_id)
WINDOW w AS (PARTITION BY quote_id ORDER BY seq, cart_id ROWS UNBOUNDED PRECEDING)"""
# The log of additions and removals one request after the other; ``live`` is the cart of the quote.
STEPS["requests"] = """
SELECT quote_id, seq, op, cart_id, coalesce(picks, []) AS picks, row_number() OVER (PARTITION BY quote_id ORDER BY seq) AS nth
FROM cart_log LEFT JOIN (
  SELECT quote_id, seq, list(struct_pack(id := id, code := code, name := name, row_ix := row_ix) ORDER BY id) AS picks FROM (
    SELECT quote_id, seq, 'I-' || CAST(seq AS VARCHAR) || '-' || CAST(ix AS VARCHAR) AS id, product_code AS code, item AS name, row_ix
    FROM (SELECT quote_id, seq, 1 AS ix, item_ix AS ref FROM cart_log WHERE op = 'items'
          UNION ALL SELECT quote_id, seq, 2, other_ix FROM cart_log WHERE op = 'items') JOIN items ON row_ix = ref
    UNION ALL
    SELECT quote_id, seq, 'P-' || CAST(seq AS VARCHAR) || '-1', 'SVC', service, row_ix
    FROM cart_log JOIN services ON row_ix = service_ix WHERE op = 'services')
  GROUP BY quote_id, seq) USING (quote_id, seq)"""
STEPS["carts"] = """
SELECT q.quote_id, coalesce(live, []) AS live, CAST(0 AS BIGINT) AS nth FROM (SELECT DISTINCT quote_id FROM cart_log) q LEFT JOIN (
  SELECT quote_id, list(struct_pack(id := cart_id, code := product_code, name := name, row_ix := CAST(-1 AS BIGINT))) AS live
  FROM lines GROUP BY quote_id) USING (quote_id)
UNION ALL
SELECT c.quote_id, CASE op WHEN 'remove' THEN list_filter(live, lambda x: x.id <> cart_id)
    WHEN 'items' THEN list_concat(live, list_filter(picks, lambda x: NOT list_contains(list_transform(live, lambda y: y.code), x.code)))
    ELSE list_concat(live, list_filter(picks, lambda x: NOT list_contains(list_transform(live, lambda y: y.name), x.name))) END, r.nth
FROM carts c JOIN requests r ON r.quote_id = c.quote_id AND r.nth = c.nth + 1"""
STEPS["live_lines"] = """
SELECT quote_id, unnest(live, recursive := true) FROM (SELECT quote_id, arg_max(live, nth) AS live FROM carts GROUP BY quote_id)"""
# Every cart re-priced, line by line, with each label of its book in place of one of its quote's two.
STEPS["offers"] = """
SELECT quote_id, 'PRICE_LIST' AS type, m.label_ix, m.label, item_surcharge = m.label AS chosen, n_batches,
  m.multiplier AS im, s.multiplier AS sm
FROM quotes q JOIN smults s ON s.book_id = q.book_id AND s.label = service_surcharge JOIN imults m ON m.book_id = q.book_id
UNION ALL
SELECT quote_id, 'PROCESSING', m.label_ix, m.label, service_surcharge = m.label, n_batches, i.multiplier, m.multiplier
FROM quotes q JOIN imults i ON i.book_id = q.book_id AND i.label = item_surcharge JOIN smults m ON m.book_id = q.book_id"""
STEPS["offered"] = """
SELECT o.quote_id, o.type, label_ix, label, chosen, n_batches, coalesce(sum(g - g * (disc_pct / 100::DOUBLE)), 0) AS net
FROM offers o LEFT JOIN (SELECT *, type AS kind FROM lines) l USING (quote_id), LATERAL (SELECT quantity * CASE
    WHEN kind = 'Item' AND is_constant THEN base_ref + add_ref WHEN kind = 'Item' THEN base_ref * im + add_ref
    WHEN kind = 'Processing' THEN base_ref * sm END AS g) p
GROUP BY ALL"""
RECURSIVE = {"carts", "walk", "walk_both", *(f"walk_{kind}" for kind in KINDS)}


def with_steps(sql: str) -> str:
    """Prefix ``sql`` with the steps it mentions, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(STEPS[name])

    visit(sql)
    if not needed:
        return sql.strip()
    word = "WITH RECURSIVE" if needed & RECURSIVE else "WITH"
    ctes = ",\n".join(f"{n} AS ({STEPS[n].strip()})" for n in STEPS if n in needed)
    return f"{word} {ctes}\n{sql.strip()}"


def money(c: str) -> str:
    return f"coalesce(CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE), 0::DOUBLE)"


def totals(lines: str, net: str = "net") -> str:
    return f"""
SELECT quote_id, coalesce(raw, 0) AS raw_total, coalesce(disc, 0) AS discount_total,
  coalesce({net}, 0) AS net_total, n_batches, coalesce({net}, 0) * n_batches AS project_total,
  CASE WHEN n_batches > 1 THEN 'batches' ELSE 'batch' END AS batch_label
FROM quotes LEFT JOIN (
  SELECT quote_id, {money('unit_price * quantity')} AS raw, {money('disc_amt')} AS disc,
    {money('final_total')} AS net
  FROM {lines} GROUP BY quote_id) USING (quote_id)"""


def filtered(catalog: str, tag_table: str, name: list[str], application: str, protocol: str,
             extra: str = "true") -> str:
    match = (f"{has('t.application', repr(application), 'ALL_APPLICATIONS')} AND "
             f"{has('t.protocol', repr(protocol), 'ALL_PROTOCOLS')}")
    same = " AND ".join(f"t.{n} IS NOT DISTINCT FROM c.{n}" for n in ["book_id", *name])
    return f"""
SELECT c.* FROM {catalog} c WHERE {extra} AND (
  EXISTS (SELECT 1 FROM {tag_table} t WHERE {same} AND {match})
  OR NOT EXISTS (SELECT 1 FROM {tag_table} t WHERE t.book_id = c.book_id AND {match}))"""


def eligible(catalog: str, tag_table: str, name: list[str], filters: dict[str, str],
             source: str = "quotes", rows: bool = False) -> str:
    match = (f"{has('t.application', 'c.application', 'ALL_APPLICATIONS')} AND "
             f"{has('t.protocol', 'c.protocol', 'ALL_PROTOCOLS')}")
    names = ", ".join(f"t.{n}" for n in name)
    same = " AND ".join(f"h.{n} = k.{n}" for n in name)
    keep = " AND ".join(f"(s.{f} = 'All' OR s.{f} = k.{c})" for f, c in filters.items())
    choices = ", ".join(f"s.{f}" for f in filters)
    listed = f"""
SELECT DISTINCT s.book_id, s.application, s.protocol, {choices}, k.row_ix FROM shapes s JOIN shown k ON k.book_id = s.book_id
  AND k.application = s.application AND k.protocol = s.protocol AND {keep}"""
    counted = f"""
, answers AS (SELECT s.*, (SELECT count(*) FROM shown k WHERE k.book_id = s.book_id
    AND k.application = s.application AND k.protocol = s.protocol AND {keep}) AS n
  FROM shapes s)
SELECT quote_id, n AS n_eligible FROM {source} JOIN answers USING
  (book_id, application, protocol, brand_filter, category_filter, group_filter)"""
    return f"""
, combos AS (SELECT DISTINCT book_id, application, protocol FROM {source}),
shapes AS (SELECT DISTINCT book_id, application, protocol, brand_filter, category_filter, group_filter
  FROM {source}),
hits AS (SELECT DISTINCT c.book_id, c.application, c.protocol, {names}
  FROM combos c JOIN {tag_table} t ON t.book_id = c.book_id WHERE {match}),
shown AS (
  SELECT h.application, h.protocol, k.* FROM hits h JOIN {catalog} k ON k.book_id = h.book_id AND {same}
  UNION ALL
  SELECT c.application, c.protocol, k.* FROM combos c JOIN {catalog} k ON k.book_id = c.book_id
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.book_id = c.book_id
    AND h.application = c.application AND h.protocol = c.protocol)){listed if rows else counted}"""


def choices(parts: str) -> str:
    return f"""
SELECT DISTINCT book_id, 0 AS ord, 'All' AS choice FROM (SELECT book_id FROM itags UNION ALL SELECT book_id FROM stags)
UNION ALL
SELECT DISTINCT book_id, 1, choice FROM ({parts}) WHERE choice NOT IN ('ALL_APPLICATIONS', 'ALL_PROTOCOLS')"""


def distinct(source: str, column: str, first: str = "All") -> str:
    return f"""
SELECT DISTINCT book_id, 0 AS ord, '{first}' AS choice FROM {source} WHERE {column} IS NOT NULL
UNION ALL
SELECT DISTINCT book_id, 1, {column} FROM {source} WHERE {column} IS NOT NULL"""


def wide(catalog: str, multipliers: str, labels: list[str], keep: str, price: str) -> str:
    columns = [
        f"CASE WHEN EXISTS (SELECT 1 FROM {multipliers} m WHERE m.book_id = c.book_id AND m.label = '{n}') "
        f"THEN (SELECT {price} FROM {multipliers} m WHERE m.book_id = c.book_id AND m.label = '{n}') END "
        f"AS \"{n}\"" for n in labels]
    return f"SELECT {keep}, {', '.join(columns)} FROM {catalog} c"


ITEM_PRICE = ("CASE WHEN c.is_constant THEN c.base_cost + c.add_cost "
              "ELSE c.base_cost * m.multiplier + c.add_cost END")
SERVICE_PRICE = "c.base_price * m.multiplier"
# Labels by kind in the 25-row table they come from.
ITEM_LABELS = [f"NATION_{n}" for n in range(1, 25, 2) if n % 10 != 9] + ["DUP"]
SERVICE_LABELS = [f"NATION_{n}" for n in range(0, 25, 2)]
BUILT_CART = ("quote_id, cart_id, product_code, name, description, type, category, base_ref, add_ref, "
              "is_constant, unit_price, quantity, disc_pct, disc_amt, final_total")
DOLLARS = "'$' || coalesce(printf('%.2f', {0}), 'NA')"


def view_columns(names: dict[str, str]) -> str:
    return ", ".join(f'{c} AS "{h}"' for c, h in names.items())


def added(kind: str, prefix: str, table: str, same: str, columns: str) -> str:
    return f"""
SELECT {BUILT_CART} FROM lines WHERE status = 'F'
UNION ALL
SELECT p.quote_id, '{prefix}-1-' || CAST(p.line_no AS VARCHAR), {columns}, 0::DOUBLE, 1::DOUBLE,
  0::DOUBLE, 0::DOUBLE, 0::DOUBLE
FROM cart_lines p JOIN {table} k ON k.row_ix = p.ref_ix
WHERE p.type = '{kind}' AND p.status = 'O' AND NOT EXISTS (
  SELECT 1 FROM lines l WHERE l.status = 'F' AND l.quote_id = p.quote_id AND {same})"""


def one_edit(joined: str, kind: str, value: str) -> str:
    return f"SELECT {edited(kind, value)} {joined}{END_EDITED}"


# All lines, with 12.5 % off those of book 2's quotes.
STEPS["refreshed"] = f"""
SELECT e.*, name, description, book_id, CASE WHEN book_id = 2 THEN 2 ELSE 1 END AS stored
FROM ({one_edit("FROM priced l JOIN quotes b USING (quote_id)", "CASE WHEN b.book_id = 2 THEN 'pct' END", "12.5::DOUBLE")}) e
JOIN (SELECT quote_id, cart_id, name, description FROM priced) USING (quote_id, cart_id)
JOIN (SELECT quote_id, book_id FROM quotes) USING (quote_id)"""

TOTAL_TEXT = """'Total (Per Batch): $' || format('{:,.2f}', net_total) || ' | Total Project (' ||
  CAST(n_batches AS VARCHAR) || ' batches): $' || format('{:,.2f}', project_total)"""

OPEN = "LEFT JOIN (SELECT DISTINCT quote_id, cart_id FROM lines WHERE status = 'O') s USING (quote_id, cart_id)"
IS_OPEN = "CASE WHEN l.status = 'O' THEN {0} END"

SQL: dict[str, str] = {
    "price_book_counts": " UNION ALL ".join(
        f"SELECT book_id, '{n}' AS table_name, count(*) AS n FROM {t} GROUP BY book_id"
        for n, t in {"items": "items", "services": "services", "item_multipliers": "imults",
                     "service_multipliers": "smults", "item_tags": "itags",
                     "service_tags": "stags", "discounts": "discounts"}.items()),
    "book_versions": f"""
SELECT 1 AS version, book_id, 'Item' AS type, row_ix, base_cost AS price FROM items
UNION ALL SELECT 1, book_id, 'Processing', row_ix, base_price FROM services
UNION ALL SELECT 2, book_id, 'Item', row_ix, base_cost FROM items WHERE book_id <> 2 OR row_ix % 3 = 2
UNION ALL SELECT 2, book_id, 'Item', row_ix, 10.5::DOUBLE FROM items_raw
WHERE book_id = 2 AND row_ix % 3 = 1 AND (add_cost IS NULL OR {number('add_cost')} IS NOT NULL)
UNION ALL SELECT 2, book_id, 'Processing', row_ix, base_price FROM services WHERE book_id <> 2""",
    "workbook_rows": """
SELECT 'part-' || CAST(row_ix // 1000 AS VARCHAR) AS book_id,
  row_number() OVER (PARTITION BY row_ix // 1000 ORDER BY row_ix) AS row_ix,
  product_code, brand, item, category, description, base_cost, add_cost, is_constant,
  application, protocol FROM items_raw""",
    "clean_items": "SELECT * FROM items",
    "item_rejects": """
SELECT book_id, row_ix, product_code, add_text AS add_cost_text, 'add_cost is not a number' AS reason
FROM items_typed WHERE base_cost IS NOT NULL AND add_text IS NOT NULL AND add_number IS NULL""",
    "clean_services": "SELECT * FROM services",
    "active_discounts": "SELECT * FROM discounts",
    "discount_rejects": f"""
SELECT book_id, row_ix, supplier, end_date AS end_date_text, CAST(amount AS VARCHAR) AS amount_text,
  'end_date is not a date' AS reason
FROM discounts_raw WHERE end_date IS NOT NULL AND {day('end_date')} IS NULL""",
    "discount_display": f"""
SELECT row_ix, {display('supplier', 'label', 'coalesce(amount, 0)', 'lower(type)')} AS display_text
FROM discounts_raw""",
    "truthy_flags": """
SELECT is_constant, coalesce(upper(is_constant) IN ('TRUE', 'T', 'YES', 'Y', '1'), false) AS flag,
  count(*) AS n FROM items_raw GROUP BY ALL""",
    "item_tags": """
SELECT book_id, brand, item, CAST(len(application) AS INTEGER) AS n_application,
  CAST(len(protocol) AS INTEGER) AS n_protocol,
  array_to_string(application, '/') AS application, array_to_string(protocol, '/') AS protocol FROM itags""",
    "service_tags": """
SELECT book_id, service, CAST(len(application) AS INTEGER) AS n_application,
  CAST(len(protocol) AS INTEGER) AS n_protocol,
  array_to_string(application, '/') AS application, array_to_string(protocol, '/') AS protocol FROM stags""",
    "tag_membership": f"""
SELECT book_id, count(*) AS n_all,
  count(*) FILTER ({has('application', "'FURNITURE'", 'ALL_APPLICATIONS')}) AS n_furniture,
  count(*) FILTER ({has('application', "' FURNITURE'", 'ALL_APPLICATIONS')}) AS n_untrimmed,
  count(*) FILTER ({has('protocol', "'proto B'", 'ALL_PROTOCOLS')}) AS n_proto_b,
  count(*) FILTER ({has('protocol', "'nope'", 'ALL_PROTOCOLS')}) AS n_wildcard
FROM itags GROUP BY book_id""",
    "item_multipliers": "SELECT * FROM imults",
    "service_multipliers": "SELECT * FROM smults",
    "surcharge_labels": """
SELECT 'PRICE_LIST' AS type, book_id, label_ix, label FROM imults
UNION ALL SELECT 'PROCESSING', book_id, label_ix, label FROM smults""",
    "multiplier_reference": f"""
SELECT quote_id, 1 AS ord, 'Items (Consumables)' AS category,
  'x' || coalesce({plain('round(item_mult, 3)')}, 'NA') AS multiplier FROM params WHERE priceable
UNION ALL
SELECT quote_id, 2, 'Processing Services', 'x' || coalesce({plain('round(service_mult, 3)')}, 'NA')
FROM params WHERE priceable""",
    "surcharge_rejects": """
SELECT quote_id, book_id, item_surcharge, service_surcharge, 'unknown surcharge' AS reason
FROM params WHERE configured AND NOT priceable""",
    "filter_items": filtered("items", "itags", ["brand", "item"], "FURNITURE", "proto A"),
    "filter_items_brand": filtered("items", "itags", ["brand", "item"], "BUILDING", "proto C",
                                   "brand = 'Brand#2' AND category = 'ECONOMY'"),
    "filter_items_fallback": filtered("items", "itags", ["brand", "item"], "BUILDING", "nope"),
    "filter_services": filtered("services", "stags", ["service"], "MACHINERY", "proto C"),
    "filter_services_group": filtered("services", "stags", ["service"], "BUILDING", "All",
                                      "grp = 'NATION_15'"),
    "eligible_items_by_quote": eligible("items", "itags", ["brand", "item"], {
        "brand_filter": "brand", "category_filter": "category"}),
    "eligible_items_by_quote_fallback": eligible("items", "itags", ["brand", "item"], {
        "brand_filter": "brand", "category_filter": "category"}, "picky_quotes"),
    "eligible_services_by_quote": eligible("services", "stags", ["service"], {"group_filter": "grp"}),
    "eligible_item_classes": eligible("items", "itags", ["brand", "item"], {
        "brand_filter": "brand", "category_filter": "category"}, rows=True),
    "eligible_service_classes": eligible("services", "stags", ["service"], {"group_filter": "grp"}, rows=True),
    "application_choices": choices(
        "SELECT book_id, unnest(application) AS choice FROM itags "
        "UNION ALL SELECT book_id, unnest(application) FROM stags"),
    "protocol_choices": choices(
        "SELECT book_id, unnest(protocol) AS choice FROM itags WHERE list_contains(application, 'MACHINERY') "
        "UNION ALL SELECT book_id, unnest(protocol) FROM stags WHERE list_contains(application, 'MACHINERY')"),
    "protocol_choices_all": choices(
        "SELECT book_id, unnest(protocol) AS choice FROM itags "
        "UNION ALL SELECT book_id, unnest(protocol) FROM stags"),
    "choice_brands": distinct("items", "brand"),
    "choice_categories": distinct("items", "category"),
    "choice_groups": distinct("services", "grp"),
    "choice_discounts": distinct("discounts", "display_text", ""),
    "item_prices_long": f"""
SELECT c.book_id, product_code, label, label_ix, {ITEM_PRICE} AS price
FROM items c JOIN imults m ON m.book_id = c.book_id""",
    "item_prices_wide": wide("items", "imults", ITEM_LABELS,
                             "book_id, product_code AS code, brand, item, description", ITEM_PRICE),
    **{f"{kind}_prices_by_label": f"""
SELECT c.book_id, c.row_ix, CAST(row_number() OVER (PARTITION BY c.book_id, c.row_ix ORDER BY label_ix) - 1
  AS INTEGER) AS position, label, {price} AS price
FROM {kind}s c JOIN {kind[0]}mults m ON m.book_id = c.book_id"""
       for kind, price in (("item", ITEM_PRICE), ("service", SERVICE_PRICE))},
    "service_prices_long": f"""
SELECT c.book_id, service, label, label_ix, {SERVICE_PRICE} AS price
FROM services c JOIN smults m ON m.book_id = c.book_id""",
    "service_prices_wide": wide("services", "smults", SERVICE_LABELS,
                                "book_id, grp, service, description", SERVICE_PRICE),
    "cart_add_items": added(
        "Item", "I", "items", "l.product_code IS NOT DISTINCT FROM k.product_code",
        "k.product_code, k.item, k.description, 'Item', k.category, k.base_cost, k.add_cost, k.is_constant"),
    "cart_add_services": added(
        "Processing", "P", "services", "l.name IS NOT DISTINCT FROM k.service",
        "'SVC', k.service, k.description, 'Processing', k.grp, k.base_price, 0::DOUBLE, false"),
    "cart_remove": f"SELECT {BUILT_CART} FROM lines WHERE status <> 'F'",
    "cart_replayed": f"""
SELECT {BUILT_CART} FROM lines WHERE quote_id NOT IN (SELECT quote_id FROM cart_log)
UNION ALL
SELECT {BUILT_CART} FROM lines SEMI JOIN (SELECT quote_id, id AS cart_id FROM live_lines) x USING (quote_id, cart_id)
UNION ALL
SELECT quote_id, id, product_code, item, description, 'Item', category, base_cost, add_cost, is_constant, 0::DOUBLE, 1::DOUBLE,
  0::DOUBLE, 0::DOUBLE, 0::DOUBLE
FROM live_lines l JOIN items i ON i.row_ix = l.row_ix WHERE id LIKE 'I-%'
UNION ALL
SELECT quote_id, id, 'SVC', service, description, 'Processing', grp, base_price, 0::DOUBLE, false, 0::DOUBLE, 1::DOUBLE,
  0::DOUBLE, 0::DOUBLE, 0::DOUBLE
FROM live_lines l JOIN services s ON s.row_ix = l.row_ix WHERE id LIKE 'P-%'""",
    "cart_rejects": """
SELECT quote_id, line_no, type, ref_ix, 'no catalog row' AS reason FROM cart_lines
WHERE type = 'Item' AND ref_ix NOT IN (SELECT row_ix FROM items)
  OR type = 'Processing' AND ref_ix NOT IN (SELECT row_ix FROM services)""",
    "cart_reprice": f"SELECT {BUILT_CART} FROM priced",
    "edit_single": one_edit(
        "FROM priced l LEFT JOIN first_edits n ON n.quote_id = l.quote_id AND n.cart_id = l.cart_id "
        "WHERE n.kind IS DISTINCT FROM 'remove'", "n.kind", "n.value"),
    **{name: f"SELECT * FROM replayed_{kind}" for kind, name in KINDS.items()},
    "bulk_percent": one_edit("FROM priced l", IS_OPEN.format("'pct'"), "12.5::DOUBLE"),
    "bulk_amount": one_edit("FROM priced l", IS_OPEN.format("'amt'"), "9000::DOUBLE"),
    "supplier_discount": one_edit(
        """FROM priced l JOIN quotes USING (quote_id)
LEFT JOIN cart_lines c ON c.quote_id = l.quote_id AND CAST(c.line_no AS VARCHAR) = l.cart_id AND c.status = 'O'
LEFT JOIN discounts d ON d.row_ix = c.discount_ix
LEFT JOIN texts t ON t.book_id = quotes.book_id AND t.display_text = d.display_text""",
        "CASE t.type WHEN 'percentage' THEN 'pct' WHEN 'amount' THEN 'amt' END",
        "CASE t.type WHEN 'percentage' THEN t.amount * 100::DOUBLE ELSE t.amount END"),
    "ambiguous_discounts": f"""
SELECT book_id, display_text FROM ({discounts('''(SELECT * REPLACE (NULL AS supplier,
  ceil(amount / 10::DOUBLE) AS amount) FROM discounts_raw)''')}) GROUP BY ALL HAVING count(*) > 1""",
    "resolved_edits": "SELECT * FROM valid",
    "replay_edits": "SELECT * FROM replayed",
    "replay_edits_with_surcharges": "SELECT * FROM replayed_both",
    "totals_after_events": f"""
SELECT quote_id, seq, cart_id, n_lines, net_total, n_batches, net_total * n_batches AS project_total,
  CASE WHEN item_surcharge <> '' AND service_surcharge <> '' AND n_lines > 0
  THEN {TOTAL_TEXT.replace('project_total', 'net_total * n_batches')} ELSE 'Total (Per Batch): $0.00' END AS text
FROM event_totals""",
    "stream_edits": "SELECT * FROM replayed",
    "stream_edits_stateful": "SELECT * FROM replayed",
    "stream_edit_summaries": "SELECT * FROM replayed",
    "stream_quote_totals": totals("replayed"),
    "edited_quote_totals": totals("replayed"),
    "stored_cart_totals": totals("replayed"),
    "quote_totals": totals("priced"),
    "quote_totals_by_label": """
SELECT quote_id, type, label_ix, label, chosen, floor(net * 100 + 0.50001) / 100 AS net_total,
  floor(net * n_batches * 100 + 0.50001) / 100 AS project_total FROM offered""",
    "invoice_totals": totals("priced", "raw - disc"),
    "grand_total_text": f"""
SELECT quote_id, CASE WHEN item_surcharge <> '' AND service_surcharge <> ''
    AND quote_id IN (SELECT quote_id FROM lines)
  THEN {TOTAL_TEXT} ELSE 'Total (Per Batch): $0.00' END AS text
FROM ({totals('priced')}) JOIN (SELECT quote_id, item_surcharge, service_surcharge FROM quotes) USING (quote_id)""",
    "quote_view": f"""
SELECT quote_id, cart_id, {view_columns(QUOTE_VIEW)}
FROM priced SEMI JOIN (SELECT quote_id FROM params WHERE configured) USING (quote_id)""",
    "quote_lines_internal": f"SELECT quote_id, cart_id, {view_columns(QUOTE_LINES)} FROM priced",
    "quote_lines_refreshed": f"SELECT quote_id, cart_id, {view_columns(QUOTE_LINES)}, book_id, stored FROM refreshed",
    "quote_totals_refreshed": f"""
SELECT t.*, book_id, CASE WHEN book_id = 2 THEN 2 ELSE 1 END AS stored
FROM ({totals('refreshed')}) t JOIN (SELECT quote_id, book_id FROM quotes) USING (quote_id)""",
    "invoice_lines": f"""
SELECT quote_id, cart_id, name AS "Item", {DOLLARS.format('unit_price')} AS "Amount",
  coalesce(description, '') AS "Description", quantity AS "Quantity",
  {DOLLARS.format('final_total')} AS "Total Amount [AUD]" FROM priced""",
    "quote_header": " UNION ALL ".join(
        f"SELECT quote_id, {i} AS ord, '{label}' AS label, coalesce(CAST({c} AS VARCHAR), '') AS value FROM quotes"
        for i, (label, c) in enumerate(HEADER, start=1)),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        text = with_steps(sql)
        # A query that opens with its own CTEs continues the list.
        out[name] = re.sub(r"\)\n, ", "),\n", text, count=1)
    return out
