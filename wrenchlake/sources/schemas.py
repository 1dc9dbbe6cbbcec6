"""Schemas of the ten shop tables."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(10, 2)
TOTAL = T.DecimalType(12, 2)

CLIENTS = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("phone", T.StringType()),
    ]
)
CARS = T.StructType(
    [
        T.StructField("car_id", T.LongType()),
        T.StructField("owner_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("license_plate", T.StringType()),
    ]
)
MECHANICS = T.StructType(
    [
        T.StructField("mechanic_id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("qualification", T.StringType()),
        T.StructField("salary", PRICE),
        T.StructField("experience", T.IntegerType()),
    ]
)
PARTS = T.StructType(
    [
        T.StructField("part_id", T.LongType()),
        T.StructField("part_name", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("price", PRICE),
        T.StructField("stock_quantity", T.IntegerType()),
    ]
)
SERVICES = T.StructType(
    [
        T.StructField("service_id", T.LongType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("price", PRICE),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("client_id", T.LongType()),
        T.StructField("car_id", T.LongType()),
        T.StructField("workplace_id", T.LongType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("payment_type_id", T.LongType()),
        T.StructField("total_amount", TOTAL),
    ]
)
PARTS_IN_ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("part_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
    ]
)
SERVICES_IN_ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("service_id", T.LongType()),
        T.StructField("mechanic_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
    ]
)
WORKPLACES = T.StructType(
    [
        T.StructField("workplace_id", T.LongType()),
        T.StructField("workplace_type", T.StringType()),
    ]
)
PAYMENT_TYPES = T.StructType(
    [
        T.StructField("payment_type_id", T.LongType()),
        T.StructField("payment_name", T.StringType()),
    ]
)

TABLES = {
    "clients": CLIENTS,
    "cars": CARS,
    "mechanics": MECHANICS,
    "parts": PARTS,
    "services": SERVICES,
    "orders": ORDERS,
    "parts_in_orders": PARTS_IN_ORDERS,
    "services_in_orders": SERVICES_IN_ORDERS,
    "workplaces": WORKPLACES,
    "payment_types": PAYMENT_TYPES,
}

# Elements of the request lists.
PART_REF = T.StructType(
    [T.StructField("part_name", T.StringType()), T.StructField("manufacturer", T.StringType())]
)
PART_LINE = T.StructType(
    [
        T.StructField("manufacturer", T.StringType()),
        T.StructField("part_name", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
    ]
)
SERVICE_LINE = T.StructType(
    [T.StructField("service_name", T.StringType()), T.StructField("quantity", T.IntegerType())]
)
