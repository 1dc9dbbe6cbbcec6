"""The periodic reports and their summaries.

Lines are summed per catalogue id before the catalogue is joined: the sums combine on
the map side, so a part or service on a third of all lines stays one row, and prices are
multiplied once per id. Report and summary are two readings of the same sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.functions.money import cents, from_cents
from wrenchlake.functions.rules import since
from wrenchlake.functions.text import like_anywhere
from wrenchlake.sources.tables import Shop


def recent_orders(shop: Shop, as_of: dt.date) -> DataFrame:
    """Orders of the last 30 days, newest first."""
    recent = shop.orders.filter(since(F.col("order_date"), as_of))
    return recent.orderBy(F.desc_nulls_first("order_date"), "order_id")


def recent_orders_summary(shop: Shop, as_of: dt.date) -> DataFrame:
    """Count and total of the same orders; the total of no orders is null."""
    recent = shop.orders.filter(since(F.col("order_date"), as_of))
    return recent.agg(F.count(F.lit(1)).alias("order_count"), F.sum("total_amount").alias("total_sum"))


def _recent_ids(shop: Shop, as_of: dt.date) -> DataFrame:
    return shop.orders.filter(since(F.col("order_date"), as_of)).select("order_id")


def _sold_per_part(shop: Shop, as_of: dt.date) -> DataFrame:
    prices = shop.parts.select("part_id", "part_name", cents(F.col("price")).alias("unit"))
    return (
        shop.parts_in_orders.join(_recent_ids(shop, as_of), "order_id")
        .groupBy("part_id")
        .agg(F.sum("quantity").alias("quantity"))
        .join(prices, "part_id")
        .withColumn("revenue", F.col("unit") * F.col("quantity"))
    )


def parts_sold(shop: Shop, as_of: dt.date) -> DataFrame:
    """Parts sold in the last 30 days by part name, all makers together."""
    return (
        _sold_per_part(shop, as_of)
        .groupBy("part_name")
        .agg(F.sum("quantity").alias("quantity_sold"), F.sum("revenue").alias("revenue"))
        .select("part_name", "quantity_sold", from_cents(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc_nulls_first("quantity_sold"), "part_name")
    )


def parts_sold_summary(shop: Shop, as_of: dt.date) -> DataFrame:
    # One row per part already, so counting rows counts distinct parts.
    return (
        _sold_per_part(shop, as_of)
        .agg(F.count("part_id").alias("part_count"), F.sum("revenue").alias("revenue"))
        .select("part_count", from_cents(F.col("revenue")).alias("total_revenue"))
    )


def _done_per_service(shop: Shop, first_day: dt.date, last_day: dt.date) -> DataFrame:
    orders = shop.orders.filter(F.col("order_date").between(first_day, last_day)).select("order_id")
    prices = shop.services.select("service_id", "service_name", cents(F.col("price")).alias("unit"))
    return (
        shop.services_in_orders.join(orders, "order_id")
        .groupBy("service_id")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(prices, "service_id")
        .withColumn("amount", F.col("unit") * F.col("times"))
    )


def popular_services(shop: Shop, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Services done from first to last day, by name. Amounts ignore the quantity on the line."""
    return (
        _done_per_service(shop, first_day, last_day)
        .groupBy("service_name")
        .agg(F.sum("times").alias("times_done"), F.sum("amount").alias("amount"))
        .select("service_name", "times_done", from_cents(F.col("amount")).alias("total_sum"))
        .orderBy(F.desc_nulls_first("times_done"), "service_name")
    )


def popular_services_summary(shop: Shop, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Distinct services and their amount; 0 if none was done."""
    return (
        _done_per_service(shop, first_day, last_day)
        .agg(F.count("service_id").alias("service_count"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))
        .select("service_count", from_cents(F.col("amount")).alias("total_sum"))
    )


def _done_per_mechanic_service(shop: Shop, as_of: dt.date, name_part: str) -> DataFrame:
    mechanics = shop.mechanics.filter(like_anywhere(F.col("full_name"), name_part)).select("mechanic_id", "full_name")
    return (
        shop.services_in_orders.join(_recent_ids(shop, as_of), "order_id")
        .groupBy("mechanic_id", "service_id")
        .agg(F.count(F.lit(1)).alias("times"), F.sum("quantity").alias("quantity"))
        .join(mechanics, "mechanic_id")
    )


def mechanic_load(shop: Shop, as_of: dt.date, name_part: str = "") -> DataFrame:
    """Service lines of the last 30 days by mechanic name, namesakes together. Amounts use the quantity."""
    prices = shop.services.select("service_id", cents(F.col("price")).alias("unit"))
    return (
        _done_per_mechanic_service(shop, as_of, name_part)
        .join(prices, "service_id")
        .groupBy("full_name")
        .agg(F.sum("times").alias("service_count"), F.sum(F.col("unit") * F.col("quantity")).alias("amount"))
        .select("full_name", "service_count", from_cents(F.col("amount")).alias("total_sum"))
        .orderBy(F.desc_nulls_first("service_count"), "full_name")
    )


def mechanic_load_summary(shop: Shop, as_of: dt.date, name_part: str = "") -> DataFrame:
    """Distinct mechanics and units of service; a line whose service is unknown counts here."""
    return _done_per_mechanic_service(shop, as_of, name_part).agg(
        F.countDistinct("mechanic_id").alias("mechanic_count"), F.sum("quantity").alias("total_services")
    )
