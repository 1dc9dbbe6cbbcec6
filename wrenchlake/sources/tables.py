"""Loading and saving the ten shop tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.sources import schemas


class Shop:
    """The ten tables as lazy DataFrames.

    Tables are given as DataFrames or as functions that return one; a function runs when its
    table is first asked for, so a query touches only the files it reads.
    """

    clients: DataFrame
    cars: DataFrame
    mechanics: DataFrame
    parts: DataFrame
    services: DataFrame
    orders: DataFrame
    parts_in_orders: DataFrame
    services_in_orders: DataFrame
    workplaces: DataFrame
    payment_types: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(schemas.TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(f"this shop has no table {name!r}")
        table = tables[name]() if callable(tables[name]) else tables[name]
        self.__dict__[name] = table
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.TABLES if name in self._tables}

    def register(self, prefix: str = "") -> None:
        """Make every table readable by name through Spark SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def load_shop(spark: SparkSession, directory: str) -> Shop:
    """Read a shop saved as one Parquet folder per table; schemas are given, never inferred."""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(schemas.TABLES[name]).parquet(f"{directory}/{name}")

    return Shop(**{name: reader(name) for name in schemas.TABLES})


def save_table(df: DataFrame, directory: str, name: str, mode: str = "error") -> None:
    """Write one table, or its state after a change, as Parquet.

    Orders are clustered by date, so row-group statistics let the recent-window reports
    skip most of the table. Write to a new directory: a change reads the old one.
    """
    if name == "orders":
        df = df.repartitionByRange("order_date", "order_id").sortWithinPartitions("order_date")
    df.write.mode(mode).parquet(f"{directory}/{name}")


def save_shop(shop: Shop, directory: str, mode: str = "error") -> None:
    for name, df in shop.tables().items():
        save_table(df, directory, name, mode)


def load_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str],
) -> DataFrame:
    """Read one table of a live database in parallel key ranges."""
    df = spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[table]])
