"""Facts laid out by order key: catalog tables bucketed and sorted by
``order_id``, so that joins of orders with their deliveries, ratings and items
need no shuffle.

The layout is paid once, when the tables are written; every later join on the
order key reads bucket i of one table with bucket i of the other in one task.
All tables have the same number of buckets, and each bucket is one file (the
rows are dealt by the bucket's own hash before the write), so bucketed scans
are as many tasks as buckets. Choose about one bucket for 128 MB of the largest
table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phaselens.sources.bindings import Model

#: Views with an order key, and the names of their tables.
ORDER_KEYED = {"orders": "fact_orders", "delivery": "fact_delivery_performance", "ratings": "fact_ratings",
               "order_lines": "order_restaurants", "order_items": "fact_order_items"}
_PASSED = ("customers", "restaurants", "partners", "menu")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """``df`` as a catalog table of ``buckets`` buckets, one file each, sorted
    by ``key``."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def lay_out(m: Model, namespace: str, buckets: int, views: dict[str, str] | None = None) -> Model:
    """Write the order-keyed views of ``m`` into a namespace (made if it is
    missing) and return the model that reads them. Views without an order key
    are ``m``'s own."""
    spark = m.orders.sparkSession
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    chosen = views or ORDER_KEYED
    for view, table in chosen.items():
        write_bucketed(getattr(m, view), f"{namespace}.{table}", "order_id", buckets)
    return laid_out(m, namespace, chosen)


def laid_out(m: Model, namespace: str, views: dict[str, str] | None = None) -> Model:
    """The model over tables that :func:`lay_out` wrote."""
    spark = m.orders.sparkSession
    tables = {view: spark.table(f"{namespace}.{table}") for view, table in (views or ORDER_KEYED).items()}
    passed = {view: (lambda v=view: getattr(m, v)) for view in _PASSED}
    return Model(passed | tables, m.calendar, m.params, m.has_restaurant_city)
