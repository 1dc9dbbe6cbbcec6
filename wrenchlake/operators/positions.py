"""Analytic windows over each client's orders, by (order_date, order_id).

A client may own a large share of all orders, so no client's orders may have to meet in one
task. Usual clients take the built-in window function. Hot clients, found by a count,
take their row positions from running counts in range partitions, their ranks from counts per day, and
their neighbours from an aggregation on the position. First, last and total values are
aggregates joined back for everybody. Without hot clients the built-in window is all there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.operators.ordered import HOT_ROWS, row_numbers, split_hot

KEY = "client_id"
ORDER = ["order_date", "order_id"]
BASE = ["order_id", "client_id", "order_date"]


def _window() -> Window:
    return Window.partitionBy(KEY).orderBy(*ORDER)


def _with(value: str) -> list[str]:
    return BASE if value in BASE else [*BASE, value]


def _numbered(orders: DataFrame, hot_rows: int) -> DataFrame:
    return row_numbers(orders, [KEY], ORDER, "row_number", hot_rows)


def _by_size(
    orders: DataFrame, columns: list[str], hot_rows: int, name: str, usual: Column, hot: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """One column from the built-in window for usual clients, and from `hot` for the others."""
    few, many = split_hot(orders.select(*columns), [KEY], hot_rows)
    found = few.select(*BASE, usual.alias(name))
    return found if many is None else found.unionByName(hot(many).select(*BASE, name))


def with_row_number(orders: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _numbered(orders.select(*BASE), hot_rows).select(*BASE, "row_number")


def _from_days(name: str, value: Column) -> Callable[[DataFrame], DataFrame]:
    """A value of (client, day), computed over one row per day and joined back to the orders."""

    def joined(orders: DataFrame) -> DataFrame:
        days = orders.groupBy(KEY, "order_date").agg(F.count(F.lit(1)).alias("n")).withColumn(name, value)
        days = days.select(F.col(KEY).alias("__k"), F.col("order_date").alias("__d"), name)
        same = F.col(KEY).eqNullSafe(F.col("__k")) & F.col("order_date").eqNullSafe(F.col("__d"))
        return orders.join(days, same)

    return joined


def _days() -> Window:
    return Window.partitionBy(KEY).orderBy("order_date")


def with_rank(orders: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    before = F.sum("n").over(_days().rowsBetween(Window.unboundedPreceding, -1))
    hot = _from_days("rank", F.coalesce(before, F.lit(0)) + 1)
    return _by_size(orders, BASE, hot_rows, "rank", F.rank().over(_days()).cast("long"), hot)


def with_dense_rank(orders: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    hot = _from_days("dense_rank", F.row_number().over(_days()))
    return _by_size(orders, BASE, hot_rows, "dense_rank", F.dense_rank().over(_days()), hot)


def with_cume_dist(orders: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    upto = F.sum("n").over(_days().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hot = _from_days("cume_dist", upto / F.sum("n").over(Window.partitionBy(KEY)))
    return _by_size(orders, BASE, hot_rows, "cume_dist", F.cume_dist().over(_days()), hot)


def _join_client(orders: DataFrame, per_client: DataFrame, how: str = "inner") -> DataFrame:
    per_client = per_client.withColumnRenamed(KEY, "__k")
    return orders.join(per_client, F.col(KEY).eqNullSafe(F.col("__k")), how).drop("__k")


def with_ntile(orders: DataFrame, buckets: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bucket numbers; the first buckets take the remainder, one row each."""

    def hot(many: DataFrame) -> DataFrame:
        totals = many.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
        rows = _join_client(_numbered(many, hot_rows), totals)
        size, extra = F.expr(f"n div {buckets}"), F.expr(f"n % {buckets}")
        in_large = F.col("row_number") <= extra * (size + 1)
        large = F.ceil(F.col("row_number") / (size + 1))
        # Past the large buckets size is at least 1; greatest() only guards the unused branch.
        small = extra + F.ceil((F.col("row_number") - extra * (size + 1)) / F.greatest(size, F.lit(1)))
        return rows.withColumn("ntile", F.when(in_large, large).otherwise(small).cast("long"))

    return _by_size(orders, BASE, hot_rows, "ntile", F.ntile(buckets).over(_window()).cast("long"), hot)


def _neighbour(orders: DataFrame, value: str, shift: int, name: str, hot_rows: int) -> DataFrame:
    """The value `shift` positions away.

    Rows of hot clients are sent to their own position, and their value to the position
    that looks at it; both meet in one aggregation on (client, position).
    """
    types = {c: orders.schema[c].dataType for c in _with(value)}

    def hot(many: DataFrame) -> DataFrame:
        position = F.col("row_number")
        nothing = {c: F.lit(None).cast(t).alias(c) for c, t in types.items()}
        here = F.struct(position.alias("place"), *ORDER, nothing[value].alias(name))
        there = F.struct((position + shift).alias("place"), *[nothing[c] for c in ORDER], F.col(value).alias(name))
        met = (
            _numbered(many, hot_rows)
            .select(KEY, F.explode(F.array(here, there)).alias("copy"))
            .select(KEY, "copy.*")
            .groupBy(KEY, "place")
            .agg(*[F.max(c).alias(c) for c in [*ORDER, name]])
        )
        return met.filter(F.col("order_id").isNotNull())

    return _by_size(orders, _with(value), hot_rows, name, F.lag(value, shift).over(_window()), hot)


def with_lag(orders: DataFrame, value: str, offset: int, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _neighbour(orders, value, offset, name, hot_rows)


def with_lead(orders: DataFrame, value: str, offset: int, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    return _neighbour(orders, value, -offset, name, hot_rows)


def with_nth_value(orders: DataFrame, value: str, n: int, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The client's n-th value; null on the rows before it, as the default frame has it."""

    def hot(many: DataFrame) -> DataFrame:
        rows = _numbered(many, hot_rows)
        nth = rows.filter(F.col("row_number") == n).select(KEY, F.col(value).alias("__v"))
        reached = F.when(F.col("row_number") >= n, F.col("__v"))
        return _join_client(rows, nth, "left").withColumn(name, reached)

    return _by_size(orders, _with(value), hot_rows, name, F.nth_value(value, n).over(_window()), hot)


def with_first_value(orders: DataFrame, value: str, name: str) -> DataFrame:
    first = orders.groupBy(KEY).agg(F.min_by(value, F.struct(*ORDER)).alias(name))
    return _join_client(orders.select(*BASE), first).select(*BASE, name)


def with_last_value(orders: DataFrame, value: str, name: str) -> DataFrame:
    """The value of the client's last order, over the full frame."""
    last = orders.groupBy(KEY).agg(F.max_by(value, F.struct(*ORDER)).alias(name))
    return _join_client(orders.select(*BASE), last).select(*BASE, name)


def with_client_share(orders: DataFrame) -> DataFrame:
    """Every order with its client's spend and its own share of it."""
    spend = orders.groupBy(KEY).agg(F.sum("total_amount").alias("client_total"))
    joined = _join_client(orders.select(*BASE, "total_amount"), spend)
    share = F.col("total_amount").cast("double") / F.col("client_total").cast("double")
    return joined.select(*BASE, "client_total", share.alias("share"))
