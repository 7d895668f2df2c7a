"""Adapter views: the quoting tables as portable SQL over the given tables.

The same text runs in Spark and in the SQL engine that checks the results. ``{name}``
stands for a base table or for another view.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    # Catalog rows with unusable prices, missing and unreadable extra costs, six spellings of
    # the flag, untrimmed and trailing-separator tags, and repeated names. Book 3 has no wildcards,
    # so that selections can match nothing there.
    "items_raw": """
SELECT CAST(p_partkey % 5 AS INT) AS book_id, p_partkey AS row_ix,
  'P' || CAST(p_partkey AS STRING) AS product_code,
  p_brand AS brand, p_name AS item, p_type AS category,
  'size ' || CAST(p_size AS STRING) AS description,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'TBC'
       ELSE CAST(p_retailprice AS STRING) END AS base_cost,
  CASE WHEN p_partkey % 23 = 0 THEN 'ask' WHEN p_size % 5 = 0 THEN CAST(p_size AS STRING) END AS add_cost,
  CASE p_partkey % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'T' WHEN 2 THEN '1' WHEN 3 THEN 'N'
       WHEN 4 THEN NULL ELSE 'false' END AS is_constant,
  CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 5 = 3 THEN 'MACHINERY' END
       WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY;HOUSEHOLD'
       WHEN 3 THEN 'AUTOMOBILE; FURNITURE' ELSE 'BUILDING;FURNITURE;' END AS application,
  CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 = 3 THEN 'proto A' END
       WHEN 1 THEN 'proto A' WHEN 2 THEN 'proto A;proto B'
       ELSE 'proto C' END AS protocol
FROM {part}""",
    "services_raw": """
SELECT CAST(s_suppkey % 5 AS INT) AS book_id, s_suppkey AS row_ix,
  'NATION_' || CAST(s_nationkey AS STRING) AS grp,
  s_name AS service, 'per run' AS description,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 'n/a'
       ELSE CAST(s_acctbal AS STRING) END AS base_price,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY;BUILDING' END AS application,
  CASE s_suppkey % 2 WHEN 0 THEN NULL ELSE 'proto A;proto C' END AS protocol
FROM {supplier}""",
    # One price book per region; book 4 has a duplicate label and a missing amount.
    "surcharges_raw": """
SELECT n_regionkey AS book_id, CAST(n_nationkey AS BIGINT) AS row_ix,
  CASE WHEN n_nationkey % 2 = 0 THEN 'PROCESSING' ELSE 'PRICE_LIST' END AS type,
  CASE WHEN n_nationkey % 10 = 9 THEN 'DUP' ELSE n_name END AS label,
  CASE WHEN n_nationkey = 14 THEN NULL
       ELSE CAST(1 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) END AS amount
FROM {nation}""",
    # End dates are text: plain, with a time, with single digits, as serial numbers, unreadable.
    "discounts_raw": """
SELECT CAST(s_suppkey % 5 AS INT) AS book_id, s_suppkey AS row_ix,
  s_name AS supplier, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'deal' END AS label,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL
       WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS DOUBLE) - CAST(20 AS DOUBLE)
       ELSE CAST(s_suppkey AS DOUBLE) / CAST(200 AS DOUBLE) END AS amount,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL
       WHEN s_suppkey % 10 = 1 THEN CAST(ends AS STRING) || ' 00:00:00'
       WHEN s_suppkey % 10 = 2 THEN CAST(ends AS STRING) || 'T12:30:00'
       WHEN s_suppkey % 10 = 3 THEN CAST(year(ends) AS STRING) || '/' || CAST(month(ends) AS STRING)
            || '/' || CAST(day(ends) AS STRING)
       WHEN s_suppkey % 10 = 4 THEN CAST(35796 + s_suppkey AS STRING)
       WHEN s_suppkey % 10 = 5 THEN CAST(day(ends) AS STRING) || '.' || CAST(month(ends) AS STRING)
            || '.' || CAST(year(ends) AS STRING)
       ELSE CAST(ends AS STRING) END AS end_date,
  CASE s_suppkey % 4 WHEN 0 THEN 'AMOUNT' WHEN 1 THEN 'Percentage' WHEN 2 THEN 'percentage'
       ELSE NULL END AS type
FROM (SELECT *, DATE '1998-01-01' + CAST(s_suppkey AS INT) AS ends FROM {supplier}) s""",
    # Every 50th quote has no item surcharge, quotes of the priority '3-MEDIUM' of book 1 name
    # one that does not exist, and book 4 has a NULL service multiplier.
    "quotes": """
SELECT o_orderkey AS quote_id, n_regionkey AS book_id, c_mktsegment AS application,
  CASE o_orderkey % 4 WHEN 0 THEN 'All' WHEN 1 THEN 'proto A' WHEN 2 THEN 'proto C' ELSE 'nope' END AS protocol,
  CASE WHEN o_orderstatus = 'P' THEN 'Brand#2' ELSE 'All' END AS brand_filter,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'ECONOMY' ELSE 'All' END AS category_filter,
  CASE WHEN o_orderstatus = 'F' THEN 'NATION_15' ELSE 'All' END AS group_filter,
  CASE WHEN o_orderkey % 50 = 0 THEN ''
       WHEN n_regionkey = 1 AND o_orderpriority = '3-MEDIUM' THEN 'RETIRED'
       WHEN n_regionkey = 4 THEN 'DUP'
       WHEN n_regionkey % 2 = 1 THEN 'NATION_' || CAST(n_regionkey AS STRING)
       ELSE 'NATION_' || CAST(n_regionkey + 5 AS STRING) END AS item_surcharge,
  CASE WHEN n_regionkey % 2 = 0 THEN 'NATION_' || CAST(n_regionkey + 20 AS STRING)
       ELSE 'NATION_' || CAST(n_regionkey + 15 AS STRING) END AS service_surcharge,
  CAST(1 + o_orderkey % 3 AS INT) AS n_batches,
  'Project of ' || c_name AS title, CAST(o_orderdate AS DATE) AS date,
  'C' || CAST(o_custkey AS STRING) AS project_id,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS platform,
  CAST(o_custkey % 96 + 1 AS INT) AS n_samples,
  CAST(o_custkey % 8 + 1 AS INT) AS samples_per_batch,
  CAST(o_custkey % 10000 AS INT) AS aimed_cells
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # One cart line per line number of an order; repeated line numbers are merged. Lines refer to any catalog row, and
    # to discounts by turns.
    "cart_lines": """
SELECT *, CAST(ref_ix % (SELECT max(s_suppkey) + 1 FROM {supplier}) AS BIGINT) AS discount_ix FROM (
SELECT l_orderkey AS quote_id, l_linenumber AS line_no,
  CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'Processing' ELSE 'Item' END AS type,
  CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN min(l_suppkey)
       ELSE min(l_partkey) END AS ref_ix,
  CASE WHEN max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'O' ELSE 'F' END AS status,
  sum(l_quantity) AS quantity, min(l_discount) * CAST(100 AS DOUBLE) AS disc_pct
FROM {lineitem} GROUP BY l_orderkey, l_linenumber) c""",
    "edit_events": """
SELECT user_id AS quote_id, CAST(1 + event_id % 5 AS STRING) AS cart_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'qty' WHEN 'view' THEN 'pct' WHEN 'purchase' THEN 'amt'
       WHEN 'signup' THEN 'bulk_pct'
       ELSE CASE WHEN value >= 250 THEN 'remove' WHEN value >= 120 THEN 'bulk_amt' ELSE 'supplier' END
       END AS op,
  value, CAST(event_id % (SELECT max(s_suppkey) + 1 FROM {supplier}) AS BIGINT) AS discount_ix
FROM {events}""",
    # Quotes that change their surcharges now and then; some to labels that their book lacks. An
    # event whose value is a percentage is a valid edit as well, with the same number.
    "surcharge_changes": """
SELECT user_id AS quote_id, event_id AS seq,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'RETIRED'
       ELSE 'NATION_' || CAST(n_regionkey + CASE WHEN n_regionkey % 2 = 0 THEN 15 ELSE 10 END AS STRING)
       END AS item_surcharge,
  'NATION_' || CAST(n_regionkey + CASE WHEN n_regionkey % 2 = 0 THEN 10 ELSE 5 END AS STRING) AS service_surcharge
FROM {events} JOIN {orders} ON o_orderkey = user_id JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
WHERE event_type = 'signup'""",
    # Events as requests on carts: most add one or two items of the few a quote deals with, some add services,
    # others remove a line of the cart before the log, or the first line of the request before.
    "cart_log": """
SELECT quote_id, seq, CASE op WHEN 'click' THEN 'items' WHEN 'view' THEN 'items' WHEN 'purchase' THEN 'services'
    ELSE 'remove' END AS op,
  1 + (quote_id * 7 + seq % 3) % (SELECT max(p_partkey) FROM {part}) AS item_ix,
  1 + (quote_id * 7 + seq % 4) % (SELECT max(p_partkey) FROM {part}) AS other_ix,
  1 + (quote_id + seq % 3) % (SELECT max(s_suppkey) FROM {supplier}) AS service_ix,
  CASE WHEN seq % 3 = 0 OR before_op IS NULL THEN CAST(1 + seq % 5 AS STRING)
       ELSE CASE WHEN before_op = 'purchase' THEN 'P-' ELSE 'I-' END || CAST(before AS STRING) || '-1' END AS cart_id
FROM (SELECT user_id AS quote_id, event_id AS seq, event_type AS op,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before_op FROM {events}) e""",
}


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its files are listed and their schema read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return [n for n in BASE_TABLES if "{" + n + "}" in sql]


@cache
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the tables in ``sf_dir``."""
    return view_over(spark, name, {n: table(spark, sf_dir, n) for n in _names(VIEWS[name])})


def view_over(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """An adapter view over base tables handed in, streams included."""
    return spark.sql(VIEWS[name], **frames)


def view_sql(name: str) -> str:
    """The view's text over tables under their own names."""
    sql = VIEWS[name]
    return sql.format(**{n: n for n in _names(sql)})
