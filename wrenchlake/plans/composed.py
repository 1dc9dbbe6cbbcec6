"""Composed queries: subqueries, staging, pivots, lateral rows, grouping sets, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.functions.money import cents, from_cents
from wrenchlake.session import stage
from wrenchlake.sources.tables import Shop


def _mean(column: str):
    """Mean as one double division of an exact sum."""
    return F.sum(column).cast("double") / F.count(column)


def orders_above_average(shop: Shop) -> DataFrame:
    """Orders above the average total (uncorrelated subquery)."""
    average = shop.orders.agg(_mean("total_amount").alias("average")).scalar()
    above = shop.orders.filter(F.col("total_amount").cast("double") > average)
    return above.select("order_id", "client_id", "total_amount")


def clients_with_last_order(shop: Shop) -> DataFrame:
    """Every client with date and total of the last order (correlated subquery in the select list)."""
    last = shop.orders.groupBy("client_id").agg(
        F.max(F.struct("order_date", "order_id", "total_amount")).alias("last")
    )
    return shop.clients.join(last, "client_id", "left").select(
        "client_id",
        "full_name",
        F.col("last.order_date").alias("last_order_date"),
        F.col("last.total_amount").alias("last_total"),
    )


def orders_above_client_average(shop: Shop) -> DataFrame:
    """Orders above their client's own average (correlated subquery in the filter)."""
    average = shop.orders.groupBy(F.col("client_id").alias("__client")).agg(_mean("total_amount").alias("average"))
    # Joined null-safe: the averages are then shuffled afresh, so AQE may split a client with very many orders.
    same = F.col("client_id").eqNullSafe(F.col("__client"))
    joined = shop.orders.filter(F.col("client_id").isNotNull()).join(average, same)
    return joined.filter(F.col("total_amount").cast("double") > F.col("average")).select(
        "order_id", "client_id", "total_amount"
    )


def staged_sales(shop: Shop, view: str = "stage_sales") -> DataFrame:
    """Sales per part staged as a temporary view and read back by SQL."""
    staged = shop.parts_in_orders.groupBy("part_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("quantity")
    )
    staged.createOrReplaceTempView(view)
    shop.parts.createOrReplaceTempView(f"{view}_parts")
    return shop.parts.sparkSession.sql(
        f"""
        SELECT p.manufacturer, count(*) AS part_count, sum(s.line_count) AS line_count, sum(s.quantity) AS quantity
        FROM {view} s JOIN {view}_parts p ON p.part_id = s.part_id
        GROUP BY p.manufacturer
        """
    )


def monthly_top_services(shop: Shop, top: int = 3) -> DataFrame:
    """The most frequent services of each month, as a chain of named steps.

    The window ranks sums, a month's services, and not lines.
    """
    by_service = (
        shop.services_in_orders.join(shop.orders.select("order_id", "order_date"), "order_id")
        .groupBy(F.trunc("order_date", "month").alias("month"), "service_id")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    by_name = (
        by_service.join(shop.services.select("service_id", "service_name"), "service_id")
        .groupBy("month", "service_name")
        .agg(F.sum("times").alias("times"))
    )
    ranked = by_name.withColumn(
        "place", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("times"), "service_name"))
    )
    return ranked.filter(F.col("place") <= top).select("month", "place", "service_name", "times")


def orders_by_month_and_payment(shop: Shop, payments: list[str]) -> DataFrame:
    """Order counts, months down and payment types across; a pair without orders is 0."""
    counted = (
        shop.orders.groupBy(F.trunc("order_date", "month").alias("month"), "payment_type_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(shop.payment_types, "payment_type_id")
    )
    wide = counted.groupBy("month").pivot("payment_name", payments).agg(F.sum("n"))
    return wide.select("month", *[F.coalesce(p, F.lit(0)).alias(f"paid_{p.lower()}") for p in payments])


def part_facts_as_rows(shop: Shop) -> DataFrame:
    """Price and stock of every part as (part_id, fact, value) rows."""
    wide = shop.parts.select(
        "part_id",
        F.col("price").cast("double").alias("price"),
        F.col("stock_quantity").cast("double").alias("stock_quantity"),
    )
    return wide.unpivot("part_id", ["price", "stock_quantity"], "fact", "value")


def last_orders_per_client(shop: Shop, n: int = 3) -> DataFrame:
    """Every client with the n newest orders (lateral join).

    Ranking keeps n rows per client in each map task before anything is shuffled, so a
    client with very many orders ships n per task.
    """
    newest = Window.partitionBy("client_id").orderBy(F.desc_nulls_first("order_date"), F.desc("order_id"))
    ranked = shop.orders.select("client_id", "order_id", "order_date", "total_amount").withColumn(
        "place", F.row_number().over(newest)
    )
    kept = ranked.filter(F.col("place") <= n)
    return shop.clients.select("client_id", "full_name").join(kept, "client_id").select(
        "client_id", "full_name", "place", "order_id", "order_date", "total_amount"
    )


def _part_sales(shop: Shop) -> DataFrame:
    """Quantity and revenue per maker and part name, the input of the grouping sets."""
    per_part = shop.parts_in_orders.groupBy("part_id").agg(F.sum("quantity").alias("quantity"))
    prices = shop.parts.select("part_id", "manufacturer", "part_name", cents(F.col("price")).alias("unit"))
    return per_part.join(prices, "part_id").withColumn("amount", F.col("unit") * F.col("quantity"))


def _grouped(grouped) -> DataFrame:
    return grouped.agg(
        F.grouping("manufacturer").alias("all_makers"),
        F.grouping("part_name").alias("all_parts"),
        F.sum("quantity").alias("quantity"),
        F.sum("amount").alias("amount"),
    ).select(
        "manufacturer", "part_name", "all_makers", "all_parts", "quantity", from_cents(F.col("amount")).alias("revenue")
    )


def revenue_rollup(shop: Shop) -> DataFrame:
    return _grouped(_part_sales(shop).rollup("manufacturer", "part_name"))


def revenue_cube(shop: Shop) -> DataFrame:
    return _grouped(_part_sales(shop).cube("manufacturer", "part_name"))


def revenue_grouping_sets(shop: Shop) -> DataFrame:
    sets = [[F.col("manufacturer")], [F.col("part_name")], []]
    return _grouped(_part_sales(shop).groupingSets(sets, "manufacturer", "part_name"))


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def page_deep(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """As `page`, for offsets of any depth: rows are dealt by ranges of the order, counted, and only the partitions that hold the page are looked at.

    No task holds more than a partition's rows, and those before the page are never sorted together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    # One row per range partition.
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    before, at = {}, 0
    for part in sorted(counts):
        if at < offset + size and at + counts[part] > offset:
            before[part] = at
        at += counts[part]
    if not before:
        return df.limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__part"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    nth = ranged.filter(F.col("__part").isin(list(before))).withColumn("__nth", start + own)
    return nth.filter((F.col("__nth") > offset) & (F.col("__nth") <= offset + size)).orderBy("__nth").select(*df.columns)


def top_orders(shop: Shop, n: int) -> DataFrame:
    """The n orders with the highest totals."""
    best = shop.orders.orderBy(F.desc_nulls_first("total_amount"), "order_id").limit(n)
    return best.select("order_id", "client_id", "total_amount")
