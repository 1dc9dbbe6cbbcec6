"""The dated reports for a whole table of date ranges, one row per request.

Lines are summed per item and day once. A range is then a difference of two running sums over the days. Distinct items are counted
without looking at a range's items: an item that was used up to the last day has one use on or before it that is its latest by then; the
range misses the item if that use lies before the first day. So the count is the items used up to the last day, less the uses before the first day whose
next use comes after the last day. The latter are pairs of days (a use and the next one), of which there are no more than the calendar has, however many lines there are;
they are counted by running sums inside blocks of days whose sizes are powers of two, of which a request needs one per size at most.

A range is closed on both sides. One with a null bound, or whose first day comes after the last, holds nothing: counts and sums are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.functions.money import cents, from_cents
from wrenchlake.operators.ordered import running_sums
from wrenchlake.session import stage
from wrenchlake.sources.tables import Shop

_EPOCH = "0001-01-01"


def _day(column: str) -> Column:
    return F.datediff(F.col(column), F.lit(_EPOCH).cast("date"))


def _ranges(requests: DataFrame) -> DataFrame:
    """(request_id, a, b): the ranges that hold a day, as day numbers."""
    days = requests.select("request_id", _day("first_day").alias("a"), _day("last_day").alias("b"))
    return days.filter(F.col("a") <= F.col("b"))


def _upto(daily: DataFrame, values: list[str]) -> DataFrame:
    """(day, values): running sums over the days that have lines."""
    return stage(running_sums(daily, [], ["day"], {v: F.col(v) for v in values}).select("day", *values))


def _last_at(points: DataFrame, asked: DataFrame, values: list[str]) -> DataFrame:
    """Per asked day the running sums of the latest day on or before it, 0 if there is none."""
    filled = points.withColumn("next", F.coalesce(F.lead("day").over(Window.orderBy("day")) - 1, F.col("day") + 1_000_000))
    # One row per day of the calendar; the days asked for lie in between.
    span = asked.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    if span["low"] is None:
        return asked.select("day", *[F.lit(0).cast("long").alias(v) for v in values])
    days = filled.filter((F.col("next") >= span["low"]) & (F.col("day") <= span["high"]))
    each = F.explode(F.sequence(F.greatest("day", F.lit(span["low"])), F.least("next", F.lit(span["high"]))))
    calendar = days.select(each.alias("day"), *values)
    return asked.join(calendar, "day", "left").select("day", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def _blocks_before(day: Column, levels: int) -> Column:
    """The blocks, one per size at most, that together hold the days from 0 up to the one before."""

    def block(level: Column) -> Column:
        number = F.call_function("shiftright", day, level)
        return F.struct(level.alias("level"), (number - 1).alias("block"), (number % 2 == 1).alias("used"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(levels)), block), lambda x: x["used"])


def _missed(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(a, b, missed): per range the uses before day a whose next use comes after day b.

    Uses and ranges meet in the blocks of the days before a; there they are sorted by the next use, latest first, and summed up.
    """
    span = pairs.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    if span["low"] is None:
        return ranges.select("a", "b", F.lit(0).cast("long").alias("missed")).limit(0)
    low, length = span["low"], span["high"] - span["low"] + 1
    # Days from the first use on, in blocks of powers of two up to the whole span.
    levels = length.bit_length()
    uses = pairs.select("next", "n", (F.col("day") - low).alias("day"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    uses = uses.select(
        "level",
        F.expr("shiftright(day, level)").alias("block"),
        (-F.col("next")).alias("place"),
        "n",
        F.lit(None).cast("int").alias("a"),
        F.lit(None).cast("int").alias("b"),
    )
    first = F.least(F.greatest(F.col("a") - low, F.lit(0)), F.lit(length))
    asked = ranges.select("a", "b", F.explode(_blocks_before(first, levels)).alias("x")).select(
        "x.level", "x.block", (-F.col("b") - 1).alias("place"), F.lit(0).cast("long").alias("n"), "a", "b"
    )
    both = uses.groupBy("level", "block", "place", "a", "b").agg(F.sum("n").alias("n")).unionByName(asked)
    # At one place uses come first, so a range counts those with a next use right after its last day.
    order = [F.col("place"), F.col("b").asc_nulls_first(), F.col("a").asc_nulls_first()]
    summed = running_sums(both, ["level", "block"], order, {"missed": F.col("n")})
    return summed.filter(F.col("a").isNotNull()).groupBy("a", "b").agg(F.sum("missed").alias("missed"))


def _by_request(requests: DataFrame, daily: DataFrame, item: str, values: list[str]) -> DataFrame:
    """(request_id, distinct, values) from (item, day, values) rows."""
    daily = stage(daily)
    per_day = daily.groupBy("day").agg(*[F.sum(v).alias(v) for v in values])
    days = Window.partitionBy(item).orderBy("day")  # an item has no more rows here than the calendar has days
    far = 10_000_000
    uses = daily.select("day", F.coalesce(F.lead("day").over(days), F.lit(far)).alias("next"), F.row_number().over(days).alias("nth"))
    pairs = stage(uses.groupBy("day", "next", (F.col("nth") == 1).alias("first")).agg(F.count(F.lit(1)).alias("n")))
    starts = pairs.filter("first").groupBy("day").agg(F.sum("n").alias("items"))
    sums = _upto(per_day.join(starts, "day", "left").fillna(0, ["items"]), [*values, "items"])
    asked = stage(_ranges(requests))
    ranges = stage(asked.select("a", "b").distinct())
    ends = ranges.select(F.col("b").alias("day")).union(ranges.select(F.col("a") - 1)).distinct()
    at = stage(_last_at(sums, ends, [*values, "items"]))
    upto = at.select(F.col("day").alias("b"), *[F.col(v).alias(f"__to_{v}") for v in [*values, "items"]])
    before = at.select((F.col("day") + 1).alias("a"), *[F.col(v).alias(f"__before_{v}") for v in values])
    missed = _missed(pairs.groupBy("day", "next").agg(F.sum("n").alias("n")), ranges)
    answered = (
        ranges.join(upto, "b")
        .join(before, "a")
        .join(missed, ["a", "b"], "left")
        .select(
            "a",
            "b",
            (F.col("__to_items") - F.coalesce("missed", F.lit(0))).alias("distinct"),
            *[(F.col(f"__to_{v}") - F.col(f"__before_{v}")).alias(v) for v in values],
        )
    )
    found = asked.join(answered, ["a", "b"])
    names = ["distinct", *values]
    return requests.select("request_id").join(found, "request_id", "left").select(
        "request_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def services_by_request(shop: Shop, requests: DataFrame) -> DataFrame:
    """(request_id, first_day, last_day) → distinct services, service lines and their amount, as popular_services_summary has them."""
    dates = shop.orders.filter(F.col("order_date").isNotNull()).select("order_id", _day("order_date").alias("day"))
    prices = shop.services.select("service_id", cents(F.col("price")).alias("unit"))
    daily = (
        shop.services_in_orders.join(dates, "order_id")
        .groupBy("service_id", "day")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(prices, "service_id")
        .select("service_id", "day", "times", F.coalesce(F.col("unit") * F.col("times"), F.lit(0)).alias("amount"))
    )
    found = _by_request(requests, daily, "service_id", ["times", "amount"])
    return found.select(
        "request_id",
        F.col("distinct").alias("service_count"),
        F.col("times").alias("times_done"),
        from_cents(F.col("amount")).alias("total_sum"),
    )


def parts_by_request(shop: Shop, requests: DataFrame) -> DataFrame:
    """(request_id, first_day, last_day) → distinct parts, pieces sold and revenue."""
    dates = shop.orders.filter(F.col("order_date").isNotNull()).select("order_id", _day("order_date").alias("day"))
    prices = shop.parts.select("part_id", cents(F.col("price")).alias("unit"))
    daily = (
        shop.parts_in_orders.join(dates, "order_id")
        .groupBy("part_id", "day")
        .agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))
        .join(prices, "part_id")
        .select("part_id", "day", "quantity", F.coalesce(F.col("unit") * F.col("quantity"), F.lit(0)).alias("amount"))
    )
    found = _by_request(requests, daily, "part_id", ["quantity", "amount"])
    return found.select(
        "request_id",
        F.col("distinct").alias("part_count"),
        F.col("quantity").alias("quantity_sold"),
        from_cents(F.col("amount")).alias("revenue"),
    )
