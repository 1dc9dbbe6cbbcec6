"""The shop's tables expressed over the star-schema test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchlake.sources.schemas import PRICE, TOTAL
from wrenchlake.sources.tables import Shop

# Position in this string numbers the payment types.
PAYMENT_CODES = "FOP"


_SCHEMAS: dict[str, T.StructType] = {}


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; its footers are read for the schema only the first time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def padded_phone(key: Column, filler: str) -> Column:
    return F.concat(F.lit("+7"), F.lpad(key.cast("string"), 10, filler))


def priority_digit() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def ordered_car_id() -> Column:
    return F.col("o_custkey") * 10 + priority_digit()


def payment_id() -> Column:
    return F.instr(F.lit(PAYMENT_CODES), F.col("o_orderstatus")).cast("long")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_name").alias("full_name"),
        padded_phone(F.col("c_custkey"), "0").alias("phone"),
    )


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = (
        star_table(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderpriority", ordered_car_id().alias("car_id"))
        .distinct()
    )
    customer = star_table(spark, sf_dir, "customer")
    return ordered.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "car_id",
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("model"),
        F.col("c_mktsegment").alias("color"),
        F.concat(F.lit("P"), F.col("car_id").cast("string")).alias("license_plate"),
    )


def mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = star_table(spark, sf_dir, "nation")
    supplier = star_table(spark, sf_dir, "supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("mechanic_id"),
        F.col("s_name").alias("full_name"),
        padded_phone(F.col("s_suppkey"), "9").alias("phone_number"),
        F.col("n_name").alias("qualification"),
        F.col("s_acctbal").cast(PRICE).alias("salary"),
        (F.col("s_suppkey") % 40).cast("int").alias("experience"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("part_name"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
        (F.col("p_size") * 40).cast("int").alias("stock_quantity"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star_table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("service_name"))
        .agg(
            F.min("p_partkey").alias("service_id"),
            F.min(F.col("p_retailprice").cast(PRICE)).alias("price"),
        )
        .select("service_id", "service_name", "price")
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("client_id"),
        ordered_car_id().alias("car_id"),
        (priority_digit() - 1).cast("long").alias("workplace_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        payment_id().alias("payment_type_id"),
        F.col("o_totalprice").cast(TOTAL).alias("total_amount"),
    )


def parts_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star_table(spark, sf_dir, "lineitem")
        .filter(F.col("l_linestatus") == "F")
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )
    )


def services_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The service of a part is settled at catalogue size, so the line table
    # joins once, on a key with many values, and never on the few service names.
    part_service = (
        star_table(spark, sf_dir, "part")
        .select("p_partkey", "p_type")
        .join(services(spark, sf_dir), F.col("p_type") == F.col("service_name"))
        .select("p_partkey", "service_id")
    )
    return (
        star_table(spark, sf_dir, "lineitem")
        .filter(F.col("l_linestatus") == "O")
        .join(part_service, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            "service_id",
            F.col("l_suppkey").alias("mechanic_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )
    )


def workplaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("workplace_id"),
        F.col("r_name").alias("workplace_type"),
    )


def payment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star_table(spark, sf_dir, "orders")
        .select(payment_id().alias("payment_type_id"), F.col("o_orderstatus").alias("payment_name"))
        .distinct()
    )


def star_shop(spark: SparkSession, sf_dir: str, **written: DataFrame) -> Shop:
    """The shop over the test tables; a table that has been written already is read from there."""
    tables = [
        clients,
        cars,
        mechanics,
        parts,
        services,
        orders,
        parts_in_orders,
        services_in_orders,
        workplaces,
        payment_types,
    ]
    return Shop(**{table.__name__: partial(table, spark, sf_dir) for table in tables} | written)
