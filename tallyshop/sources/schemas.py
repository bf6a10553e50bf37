"""Schemas of the thirteen retail tables (and of the horizon file of a forecast)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    fields = [pair.split() for pair in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        "customer_id long, zip long, city string, signup_date date, gender string,"
        "age_group string, acquisition_channel string"
    ),
    "geography": _schema("zip long, city string, region string, district string"),
    "products": _schema(
        "product_id long, product_name string, category string, segment string, size string,"
        "color string, price double, cogs double"
    ),
    "promotions": _schema(
        "promo_id string, promo_name string, promo_type string, discount_value double,"
        "start_date date, end_date date, applicable_category string, promo_channel string,"
        "stackable_flag long, min_order_value long"
    ),
    "orders": _schema(
        "order_id long, order_date date, customer_id long, zip long, order_status string,"
        "payment_method string, device_type string, order_source string"
    ),
    "order_items": _schema(
        "order_id long, product_id long, quantity long, unit_price double,"
        "discount_amount double, promo_id string, promo_id_2 string"
    ),
    "payments": _schema(
        "order_id long, payment_method string, payment_value double, installments long"
    ),
    "shipments": _schema(
        "order_id long, ship_date date, delivery_date date, shipping_fee double"
    ),
    "returns": _schema(
        "return_id string, order_id long, product_id long, return_date date,"
        "return_reason string, return_quantity long, refund_amount double"
    ),
    "reviews": _schema(
        "review_id string, order_id long, product_id long, customer_id long, review_date date,"
        "rating long, review_title string"
    ),
    "inventory": _schema(
        "snapshot_date date, product_id long, stock_on_hand long, units_received long,"
        "units_sold long, stockout_days long, days_of_supply double, fill_rate double,"
        "stockout_flag long, overstock_flag long, reorder_flag long, sell_through_rate double,"
        "product_name string, category string, segment string, year long, month long"
    ),
    "web_traffic": _schema(
        "date date, sessions long, unique_visitors long, page_views long, bounce_rate double,"
        "avg_session_duration_sec double, traffic_source string"
    ),
    "sales": _schema("Date date, Revenue double, COGS double"),
    "sample_submission": _schema("Date date, Revenue double, COGS double"),
}
