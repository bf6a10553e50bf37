"""The retail tables derived from the TPC-H-like driver tables.

Each view is one SQL text both Spark and DuckDB read, so the oracle sees the very same input.
``{name}`` stands for a driver table or an earlier view. Money is exact decimal throughout;
rates are doubles made by one division.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallyshop.sources.tables import Catalog

DRIVER_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {}

VIEWS["r_geography"] = """
SELECT cast(n.n_nationkey AS bigint) AS zip, n.n_name AS city, r.r_name AS region,
       'District ' || cast(n.n_nationkey % 7 AS string) AS district
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["r_customers"] = """
SELECT c.c_custkey AS customer_id, cast(c.c_nationkey AS bigint) AS zip, g.city AS city,
       cast(date '1994-07-01' + cast((c.c_custkey * 7) % 1500 AS int) * interval '1' day AS date) AS signup_date,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL
            WHEN c.c_acctbal < 1000 THEN '18-24' WHEN c.c_acctbal < 3000 THEN '25-34'
            WHEN c.c_acctbal < 5000 THEN '35-44' WHEN c.c_acctbal < 7500 THEN '45-54'
            ELSE '55+' END AS age_group,
       c.c_mktsegment AS acquisition_channel
FROM {customer} c LEFT JOIN {r_geography} g ON g.zip = c.c_nationkey
"""

VIEWS["r_products"] = """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS segment,
       CASE WHEN p_size <= 12 THEN 'S' WHEN p_size <= 25 THEN 'M' WHEN p_size <= 38 THEN 'L' ELSE 'XL' END AS size,
       'color ' || cast(p_partkey % 10 AS string) AS color,
       cast(p_retailprice AS decimal(10,2)) AS price,
       cast(cast(p_retailprice AS decimal(10,2)) * cast(0.50 AS decimal(3,2))
            + cast(4 * (p_partkey % 10) AS decimal(10,2)) AS decimal(12,2)) AS cogs
FROM {part}
"""

VIEWS["r_orders"] = """
SELECT o.o_orderkey AS order_id, cast(o.o_orderdate AS date) AS order_date,
       o.o_custkey AS customer_id, cast(c.c_nationkey AS bigint) AS zip,
       CASE o.o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'shipped'
            ELSE CASE WHEN o.o_orderkey % 9 = 0 THEN 'returned' ELSE 'delivered' END END AS order_status,
       o.o_orderpriority AS payment_method,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
       CASE (o.o_custkey + o.o_orderkey % 2) % 4 WHEN 0 THEN 'organic_search' WHEN 1 THEN 'paid_search'
            WHEN 2 THEN 'social_media' ELSE 'direct' END AS order_source
FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

# Sums run over whole cents (and hundredths of cents): integers aggregate faster than decimals
# and are just as exact.
VIEWS["r_order_items"] = """
SELECT order_id, product_id, quantity,
       cast(cast(cast(floor(cast(gross_cents AS double) / quantity) AS bigint) AS decimal(12,0))
            * cast(0.01 AS decimal(3,2)) AS decimal(12,2)) AS unit_price,
       cast(cast(discount_e4 * CASE top_discount WHEN 8 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 4 ELSE 1 END AS decimal(18,0))
            * cast(0.0001 AS decimal(5,4)) AS decimal(18,4)) AS discount_amount,
       CASE WHEN top_discount >= 7 THEN 'PROMO-' || cast(top_discount AS string) END AS promo_id,
       CASE WHEN top_discount >= 7 AND (order_id + product_id) % 10 = 0 THEN 'PROMO-9' END AS promo_id_2
FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id,
             cast(sum(cast(l_quantity AS bigint)) AS bigint) AS quantity,
             cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS gross_cents,
             cast(sum(cast(round(l_extendedprice * 100) AS bigint) * cast(round(l_discount * 100) AS bigint)) AS bigint) AS discount_e4,
             max(cast(round(l_discount * 100) AS int)) AS top_discount
      FROM {lineitem} GROUP BY l_orderkey, l_partkey) g
"""

VIEWS["r_payments"] = """
SELECT o.order_id AS order_id,
       CASE WHEN o.order_id % 50 = 0 THEN 'voucher' ELSE o.payment_method END AS payment_method,
       cast(i.net + CASE WHEN o.order_id % 97 = 0 THEN 1 ELSE 0 END AS decimal(18,4)) AS payment_value,
       CASE o.order_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 12 END AS installments
FROM (SELECT order_id, sum(cast(quantity * unit_price AS decimal(18,4)) - discount_amount) AS net
      FROM {r_order_items} GROUP BY order_id) i
JOIN {r_orders} o ON o.order_id = i.order_id
"""

VIEWS["r_shipments"] = """
SELECT order_id, ship_date,
       cast(ship_date + cast(2 + order_id % 6 AS int) * interval '1' day AS date) AS delivery_date,
       cast(cast(order_id % 5 AS decimal(4,0)) * cast(1.25 AS decimal(3,2)) AS decimal(10,2)) AS shipping_fee
FROM (SELECT order_id,
             cast(order_date + cast(1 + order_id % 3 AS int) * interval '1' day AS date) AS ship_date
      FROM {r_orders} WHERE order_status <> 'cancelled' OR order_id % 101 = 0) s
"""

VIEWS["r_returns"] = """
SELECT 'R' || cast(l.l_orderkey AS string) || '-' || cast(l.l_partkey AS string) || '-' || cast(l.l_linenumber AS string) AS return_id,
       l.l_orderkey AS order_id, l.l_partkey AS product_id,
       cast(max(o.order_date) + cast(10 + l.l_orderkey % 20 AS int) * interval '1' day AS date) AS return_date,
       CASE l.l_partkey % 5 WHEN 0 THEN 'wrong_size' WHEN 1 THEN 'defective' WHEN 2 THEN 'not_as_described'
            WHEN 3 THEN 'changed_mind' ELSE 'late_delivery' END AS return_reason,
       cast(sum(cast(l.l_quantity AS bigint)) AS bigint) AS return_quantity,
       cast(cast(cast(sum(cast(round(l.l_extendedprice * 100) AS bigint) * (100 - cast(round(l.l_discount * 100) AS bigint))) AS bigint) AS decimal(18,0))
            * cast(0.0001 AS decimal(5,4)) AS decimal(18,4)) AS refund_amount
FROM {lineitem} l JOIN {r_orders} o ON o.order_id = l.l_orderkey
WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_orderkey % 4 = 0 AND o.order_status <> 'cancelled'
GROUP BY l.l_orderkey, l.l_partkey, l.l_linenumber
"""

VIEWS["r_reviews"] = """
SELECT 'V' || cast(i.order_id AS string) || '-' || cast(i.product_id AS string) AS review_id,
       i.order_id AS order_id, i.product_id AS product_id, o.customer_id AS customer_id,
       cast(o.order_date + cast(15 + i.product_id % 15 AS int) * interval '1' day AS date) AS review_date,
       1 + (7 * i.order_id + i.product_id) % 5 AS rating,
       CASE (7 * i.order_id + i.product_id) % 5 WHEN 0 THEN 'Bad' WHEN 4 THEN 'Excellent' ELSE 'Okay' END AS review_title
FROM {r_order_items} i JOIN {r_orders} o ON o.order_id = i.order_id
WHERE o.order_status = 'delivered' AND (i.order_id + i.product_id) % 5 = 0
"""

VIEWS["r_promotions"] = """
SELECT * FROM (VALUES
 ('PROMO-7', 'Spring Sale 1995', 'percentage', cast(7 AS decimal(6,2)), date '1995-03-15', date '1995-06-15', 'ECONOMY', 'email', 1, 0),
 ('PROMO-8', 'Year End 1997', 'fixed', cast(50 AS decimal(6,2)), date '1997-11-01', date '1998-01-31', NULL, 'online', 0, 200000),
 ('PROMO-9', 'New Year 1998', 'percentage', cast(12.50 AS decimal(6,2)), date '1998-01-01', date '1998-03-31', 'STANDARD', 'all_channels', 1, 0),
 ('PROMO-10', 'Urban Blowout 2001', 'percentage', cast(20 AS decimal(6,2)), date '2001-06-15', date '2001-09-30', NULL, 'email', 0, 50000)
) AS t(promo_id, promo_name, promo_type, discount_value, start_date, end_date, applicable_category, promo_channel, stackable_flag, min_order_value)
"""

VIEWS["r_inventory"] = """
SELECT snapshot_date, s.product_id AS product_id, stock_on_hand,
       units_sold + s.product_id % 40 - 2 AS units_received, units_sold, stockout_days,
       CASE WHEN s.product_id % 60 = 0 THEN 1.0 ELSE 0.0 END + cast(stock_on_hand * 30 AS double) / units_sold AS days_of_supply,
       1.0 - cast(stockout_days AS double) / 31 AS fill_rate,
       CASE WHEN stockout_days > 0 THEN 1 ELSE 0 END AS stockout_flag,
       CASE WHEN stock_on_hand > 3 * units_sold THEN 1 ELSE 0 END AS overstock_flag,
       CASE WHEN stock_on_hand < units_sold THEN 1 ELSE 0 END AS reorder_flag,
       cast(units_sold AS double) / (units_sold + stock_on_hand) AS sell_through_rate,
       p.product_name AS product_name, p.category AS category, p.segment AS segment,
       year(snapshot_date) AS year,
       CASE WHEN s.product_id % 211 = 0 THEN 1 + month(snapshot_date) % 12 ELSE month(snapshot_date) END AS month
FROM (SELECT last_day(o.order_date) AS snapshot_date, i.product_id AS product_id,
             cast(sum(i.quantity) AS bigint) AS units_sold,
             20 + (7 * i.product_id + 3 * month(last_day(o.order_date))) % 100 AS stock_on_hand,
             greatest(0, (i.product_id + month(last_day(o.order_date))) % 9 - 4) AS stockout_days
      FROM {r_order_items} i JOIN {r_orders} o ON o.order_id = i.order_id
      GROUP BY last_day(o.order_date), i.product_id) s
JOIN {r_products} p ON p.product_id = s.product_id
"""

VIEWS["r_web_traffic"] = """
SELECT cast(cast(ts AS date) - 8401 * interval '1' day AS date) AS date, count(*) AS sessions, count(DISTINCT user_id) AS unique_visitors,
       cast(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS bigint) AS page_views,
       cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS double) / count(*) AS bounce_rate,
       cast(sum(cast(value AS decimal(12,2))) AS double) / count(*) AS avg_session_duration_sec,
       CASE user_id % 4 WHEN 0 THEN 'organic_search' WHEN 1 THEN 'paid_search'
            WHEN 2 THEN 'social_media' ELSE 'direct' END AS traffic_source
FROM {events}
GROUP BY cast(cast(ts AS date) - 8401 * interval '1' day AS date),
         CASE user_id % 4 WHEN 0 THEN 'organic_search' WHEN 1 THEN 'paid_search'
              WHEN 2 THEN 'social_media' ELSE 'direct' END
"""

VIEWS["r_sales"] = """
SELECT o.order_date AS Date,
       sum(cast(i.quantity * i.unit_price AS decimal(18,4)) - i.discount_amount) AS Revenue,
       sum(cast(i.quantity * p.cogs AS decimal(18,4))) AS COGS
FROM {r_order_items} i
JOIN {r_orders} o ON o.order_id = i.order_id
JOIN {r_products} p ON p.product_id = i.product_id
GROUP BY o.order_date
"""


def placeholders(sql: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def retail_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Catalogue of the retail tables over one folder of driver Parquet files."""

    def read(name: str) -> DataFrame:
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        # nearly every line is an (order, product) of its own: lines meet by order before they are summed, in shares of bounded size, where a
        # scan that summed first would hold all its groups; joins on the order then find them in place
        return table.repartition("l_orderkey") if name == "lineitem" else table

    def build(name: str) -> DataFrame:
        return spark.sql(VIEWS[name], **{d: node(d) for d in placeholders(VIEWS[name])})

    def node(name: str) -> DataFrame:
        return catalog[name[2:]] if name.startswith("r_") else read(name)

    catalog = Catalog(spark, {name[2:]: partial(build, name) for name in VIEWS}, folder)
    return catalog
