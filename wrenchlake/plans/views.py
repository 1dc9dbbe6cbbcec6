"""The joined views, and the lookups the screens made on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.functions.rules import since
from wrenchlake.sources.tables import Shop


def car_full_info(shop: Shop) -> DataFrame:
    """Clients with their cars."""
    return shop.clients.join(shop.cars, F.col("client_id") == F.col("owner_id")).select(
        "client_id", "full_name", "phone", "car_id", "model", "color", "license_plate"
    )


def client_orders(shop: Shop) -> DataFrame:
    """Orders with their client's name and phone."""
    return shop.orders.join(shop.clients, "client_id").select(
        "order_id",
        "order_date",
        "total_amount",
        "client_id",
        F.col("full_name").alias("client_name"),
        F.col("phone").alias("client_phone"),
    )


def parts_in_order(shop: Shop) -> DataFrame:
    """Part lines with the part's name."""
    return shop.parts_in_orders.join(shop.parts, "part_id").select("order_id", "part_id", "part_name", "quantity")


def mechanic_orders(shop: Shop) -> DataFrame:
    """Service lines with service, order date and total."""
    return (
        shop.services_in_orders.join(shop.services, "service_id")
        .join(shop.orders, "order_id")
        .select("order_id", "service_name", "order_date", "total_amount", "mechanic_id")
    )


def client_card(shop: Shop, client_id: int) -> DataFrame:
    return shop.clients.filter(F.col("client_id") == client_id).select("client_id", "full_name", "phone")


def client_cards(shop: Shop, ids: DataFrame) -> DataFrame:
    """The cards of all requested (client_id) rows."""
    return shop.clients.join(ids, "client_id", "left_semi").select("client_id", "full_name", "phone")


def client_order_history(shop: Shop, client_id: int | None = None) -> DataFrame:
    """Orders of one client, or of all, one row per service line; newest first.

    An order without service lines does not appear, nor a line without a mechanic.
    """
    orders = shop.orders if client_id is None else shop.orders.filter(F.col("client_id") == client_id)
    return (
        shop.services_in_orders.select("order_id", "mechanic_id")
        .join(shop.mechanics.select("mechanic_id", "phone_number"), "mechanic_id")
        .join(orders.select("order_id", "client_id", "car_id", "order_date", "total_amount"), "order_id")
        .join(shop.cars.select("car_id", "model", "license_plate"), "car_id")
        # The order id spreads a client's busy day over several sort partitions.
        .orderBy("client_id", F.desc_nulls_first("order_date"), "order_id")
        .select(
            "client_id",
            "order_date",
            "model",
            "license_plate",
            F.col("phone_number").alias("mechanic_phone"),
            "total_amount",
        )
    )


def mechanic_recent_orders(shop: Shop, as_of: dt.date, mechanic_id: int | None = None) -> DataFrame:
    """Recent service lines of one mechanic, or of all; newest first."""
    lines = mechanic_orders(shop).filter(since(F.col("order_date"), as_of))
    if mechanic_id is not None:
        lines = lines.filter(F.col("mechanic_id") == mechanic_id)
    return lines.orderBy("mechanic_id", F.desc_nulls_first("order_date"), "order_id")


def parts_by_name(shop: Shop, terms: DataFrame) -> DataFrame:
    """Parts whose name equals one of the (term) texts, trimmed; an empty term keeps every part."""
    wanted = terms.select(F.trim("term").alias("part_name")).distinct()
    keep_all = wanted.agg(F.coalesce(F.max(F.col("part_name") == ""), F.lit(False)).alias("all")).scalar()
    hit = wanted.withColumn("hit", F.lit(True))
    return shop.parts.join(hit, "part_name", "left").filter(F.col("hit") | keep_all).select(*shop.parts.columns)


def orders_by_client_name(shop: Shop, names: DataFrame) -> DataFrame:
    """(full_name) → orders of the first client of that name; other namesakes are not followed."""
    first = (
        shop.clients.join(names.select(F.trim("full_name").alias("full_name")).distinct(), "full_name", "left_semi")
        .groupBy("full_name")
        .agg(F.min("client_id").alias("client_id"))
    )
    return shop.orders.join(first, "client_id").select("full_name", *shop.orders.columns)


def sort_table(df: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Sort any table by any of its columns; nulls are the largest values.

    Equal values are ordered by `tie`, the first column if none is named, so a column of
    few values still spreads over many sort partitions.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; have {df.columns}")
    key = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(key, tie or df.columns[0])


def first_row(df: DataFrame, key: str) -> DataFrame:
    """The row with the lowest key."""
    return df.orderBy(key).limit(1)


def clients_without_orders(shop: Shop) -> DataFrame:
    return shop.clients.join(shop.orders.select("client_id"), "client_id", "left_anti")


def parts_used(parts: DataFrame, part_lines: DataFrame) -> DataFrame:
    """Parts on any order line, however old."""
    return parts.join(part_lines.select("part_id"), "part_id", "left_semi")


def parts_unused(parts: DataFrame, part_lines: DataFrame) -> DataFrame:
    return parts.join(part_lines.select("part_id"), "part_id", "left_anti")
