"""A small data set in the reference's own schema, holding the edge rows
listed in FIXTURES.md part B."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from phaselens.sources import schemas as S
from phaselens.sources.bindings import Model

T = dt.datetime
US = dt.timedelta(microseconds=1)


def _orders():
    rows = []
    n = [0]

    def add(cust, rest, ts, total="100.00", cancelled="N", partner="P1"):
        n[0] += 1
        rows.append((f"O{n[0]:03d}", cust, rest, partner, ts, Decimal(total), Decimal("5.00"),
                     Decimal("10.00"), Decimal(total), "N", cancelled))

    # phase boundaries: exactly at and one microsecond before each cut, NULL time
    add("C1", "R1", T(2025, 6, 1))
    add("C1", "R1", T(2025, 6, 1) - US)
    add("C3", "R1", T(2025, 8, 1))
    add("C3", "R1", T(2025, 8, 1) - US)
    add("C3", "R1", None)
    # orphan customer (not in the dimension), NULL delivery partner
    add("CX", "R1", T(2025, 2, 10), partner=None)
    add("CX", "R1", T(2025, 6, 10), cancelled="Y")
    # C2: exactly two pre-crisis orders, one cancelled -> still loyal; no crisis order
    add("C2", "R2", T(2025, 1, 5), "250.00")
    add("C2", "R2", T(2025, 2, 5), "250.00", cancelled="Y")
    # R10: ten pre-crisis orders and none in the crisis; R9: nine; R11 keeps crisis orders
    for i in range(10):
        add("C4", "R10", T(2025, 1 + i % 5, 3 + i), "40.00")
    for i in range(9):
        add("C5", "R9", T(2025, 1 + i % 5, 4 + i), "30.00")
    for i in range(12):
        add("C6", "R11", T(2025, 1 + i % 5, 5 + i), "20.00")
    add("C6", "R11", T(2025, 6, 20), "20.00")
    add("C6", "R11", T(2025, 7, 20), "20.00")
    # the last order 14 hours before the RFM reference date
    add("C7", "R1", T(2025, 9, 30, 10, 0), "80.00")
    return rows


def reference_model(spark) -> Model:
    orders = spark.createDataFrame(_orders(), S.FACT_ORDERS)
    customers = spark.createDataFrame([
        ("C1", "2024-01-01", "Delhi", "Organic"), ("C2", "2024-01-01", "Delhi", "Paid"),
        ("C3", "2024-01-01", "Mumbai", "Organic"), ("C4", "2024-01-01", "Mumbai", "Referral"),
        ("C5", "2024-01-01", "Pune", "Organic"), ("C6", "2024-01-01", "Pune", "Paid"),
        ("C7", "2024-01-01", "Delhi", "Organic"), ("C8", "2024-01-01", "Delhi", "Organic"),
    ], S.DIM_CUSTOMER)
    restaurants = spark.createDataFrame([
        (f"R{i}", f"Rest {i}", "Delhi", "North Indian" if i % 2 else "Chinese",
         "Standalone" if i % 3 else "Cloud Kitchen", "20", "Y" if i != 10 else "N")
        for i in (1, 2, 9, 10, 11)], S.DIM_RESTAURANT)
    delivery = spark.createDataFrame([
        ("O001", 40, 40, 2.0),   # actual = expected: not a breach
        ("O002", 50, 40, 2.0),
        ("O003", 30, 40, 1.0),
    ], S.FACT_DELIVERY_PERFORMANCE)
    ratings = spark.createDataFrame([
        ("O001", "C1", "R1", 2.5, "late2 café bad_x cold, stale-late 5late it's", "2025-06-01 10:00", 0.0),
        ("O001", "C1", "R1", 1.0, "late and cold", "01-06-2025 10:00", -0.5),  # two ratings, one order
        ("O002", "C1", "R1", 4.5, "fine", "13/06/2025", 0.9),
        ("O004", "C3", "R1", 2.0, "stale stale", "06/13/2025", -0.4),
        ("O008", "C2", "R2", 5.0, "great", "2025-13-06", 0.8),
        ("O011", "C4", "R10", 3.0, None, "1-6-2025 9:05", 0.1),  # only review_text NULL
        (None, None, None, None, None, None, None),  # fully blank
    ], S.FACT_RATINGS)
    empty_items = spark.createDataFrame([], S.FACT_ORDER_ITEMS)
    partners = spark.createDataFrame([("P1", "Ravi", "Delhi", "Bike", "Full", 4.2, "Y")],
                                     S.DIM_DELIVERY_PARTNER)
    menu = spark.createDataFrame([("M1", "R1", "Dal", "Main", "Y", Decimal("120.00"))], S.DIM_MENU_ITEM)
    return Model.from_reference({
        "fact_orders": orders, "fact_order_items": empty_items, "fact_ratings": ratings,
        "fact_delivery": delivery, "dim_customer": customers, "dim_restaurant": restaurants,
        "dim_delivery_partner": partners, "dim_menu_item": menu,
    })
