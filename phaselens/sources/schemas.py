"""Declared schemas of the reference's eight tables (never inferSchema)."""

from __future__ import annotations

from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, StringType,
                               StructField, StructType, TimestampNTZType)

_S, _D, _I, _M = StringType(), DoubleType(), IntegerType(), DecimalType(18, 2)


def _schema(*cols) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


DIM_CUSTOMER = _schema(("customer_id", _S), ("signup_date", _S), ("city", _S),
                       ("acquisition_channel", _S))
DIM_RESTAURANT = _schema(("restaurant_id", _S), ("restaurant_name", _S), ("city", _S),
                         ("cuisine_type", _S), ("partner_type", _S),
                         ("avg_prep_time_min", _S), ("is_active", _S))
DIM_DELIVERY_PARTNER = _schema(("delivery_partner_id", _S), ("partner_name", _S), ("city", _S),
                               ("vehicle_type", _S), ("employment", _S),
                               ("avg_rating", _D), ("is_active", _S))
DIM_MENU_ITEM = _schema(("menu_item_id", _S), ("restaurant_id", _S), ("item_name", _S),
                        ("category", _S), ("is_veg", _S), ("price", _M))
FACT_ORDERS = _schema(("order_id", _S), ("customer_id", _S), ("restaurant_id", _S),
                      ("delivery_partner_id", _S), ("order_timestamp", TimestampNTZType()),
                      ("subtotal_amount", _M), ("discount_amount", _M), ("delivery_fee", _M),
                      ("total_amount", _M), ("is_cod", _S), ("is_cancelled", _S))
FACT_ORDER_ITEMS = _schema(("order_id", _S), ("item_id", _S), ("menu_item_id", _S),
                           ("restaurant_id", _S), ("quantity", _I), ("unit_price", _M),
                           ("item_discount", _M), ("line_total", _M))
FACT_RATINGS = _schema(("order_id", _S), ("customer_id", _S), ("restaurant_id", _S),
                       ("rating", _D), ("review_text", _S), ("review_timestamp", _S),
                       ("sentiment_score", _D))
FACT_DELIVERY_PERFORMANCE = _schema(("order_id", _S), ("actual_delivery_time_mins", _I),
                                    ("expected_delivery_time_mins", _I), ("distance_km", _D))

# Logical table name -> (CSV file name, schema).
REFERENCE_TABLES = {
    "fact_orders": ("fact_orders.csv", FACT_ORDERS),
    "fact_order_items": ("fact_order_items.csv", FACT_ORDER_ITEMS),
    "fact_ratings": ("fact_ratings.csv", FACT_RATINGS),
    "fact_delivery": ("fact_delivery_performance.csv", FACT_DELIVERY_PERFORMANCE),
    "dim_customer": ("dim_customer.csv", DIM_CUSTOMER),
    "dim_restaurant": ("dim_restaurant.csv", DIM_RESTAURANT),
    "dim_delivery_partner": ("dim_delivery_partner_.csv", DIM_DELIVERY_PARTNER),
    "dim_menu_item": ("dim_menu_item.csv", DIM_MENU_ITEM),
}
