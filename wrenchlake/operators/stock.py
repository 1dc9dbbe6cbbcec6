"""Stock rules: selling, returning, availability, deleting parts in use.

A sale lowers the stock of its part; a sale larger than the stock is refused. A
null stock or an unknown part never refuses. Quantities are positive.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.operators.contention import FOLD_LINES, admit_lines, refused_requests
from wrenchlake.operators.ordered import HOT_ROWS, running_sums
from wrenchlake.session import stage


class Sold(NamedTuple):
    parts: DataFrame
    accepted: DataFrame
    rejects: DataFrame


class Deletion(NamedTuple):
    parts: DataFrame
    blocked: DataFrame


def check_availability(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """(request_id, part_id, quantity) → the same with `available`.

    An unknown part or a null quantity is not available; an unknown stock counts as 0.
    """
    stock = parts.select("part_id", F.coalesce("stock_quantity", F.lit(0)).alias("stock"))
    enough = F.coalesce(F.col("stock") >= F.col("quantity"), F.lit(False))
    return requests.join(stock, "part_id", "left").select(
        "request_id", "part_id", "quantity", enough.alias("available")
    )


def lower_stock(parts: DataFrame, sold: DataFrame) -> DataFrame:
    """Parts after (part_id, sold) has left the stock."""
    left = (F.col("stock_quantity") - F.coalesce("sold", F.lit(0))).cast("int")
    return parts.join(sold, "part_id", "left").withColumn("stock_quantity", left).select(*parts.columns)


def sold_by_part(lines: DataFrame) -> DataFrame:
    """(part_id, sold): the quantity of all lines of a part."""
    return lines.groupBy("part_id").agg(F.sum("quantity").alias("sold"))


def sell_as_statement(parts: DataFrame, lines: DataFrame) -> Sold:
    """Sell all lines as one statement: one overdrawn part refuses the whole batch."""
    sold = sold_by_part(lines)
    overdrawn = sold.join(parts.select("part_id", "stock_quantity"), "part_id").filter(
        F.col("sold") > F.col("stock_quantity")
    )
    refused = overdrawn.agg((F.count(F.lit(1)) > 0).alias("refused")).scalar()
    marked = lines.withColumn("reason", F.when(refused, F.lit(K.INSUFFICIENT_STOCK)))
    kept = sold.withColumn("sold", F.when(refused, F.lit(0)).otherwise(F.col("sold")))
    return Sold(
        parts=lower_stock(parts, kept),
        accepted=marked.filter(F.col("reason").isNull()).drop("reason"),
        rejects=marked.filter(F.col("reason").isNotNull()),
    )


def sell_by_prefix(
    parts: DataFrame,
    lines: DataFrame,
    arrival: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> Sold:
    """Sell each part's lines in their order of arrival until its stock would run short.

    The first line that does not fit and every later line of that part are refused. Only lines of parts that may run short, as all that
    their lines take is more than they hold, are summed up in order.
    """
    quantity = F.col("quantity").cast("long")
    stock = parts.select("part_id", "stock_quantity")
    # No sum on the way is larger than that of the quantities above 0.
    most = lines.groupBy("part_id").agg(F.sum(F.greatest(quantity, F.lit(0))).alias("most"))
    # Written, it is a list of known size.
    tight = stage(stock.join(most, "part_id").filter(F.col("most") > F.col("stock_quantity")).select("part_id"))
    running = running_sums(lines.join(tight, "part_id", "left_semi"), ["part_id"], arrival, {"running": quantity}, hot_rows)
    over = F.coalesce(F.col("running") > F.col("stock_quantity"), F.lit(False))
    marked = running.join(stock, "part_id", "left").withColumn("over", over)
    # As above, a line comes once for each stored row of its part.
    ample = lines.join(tight, "part_id", "left_anti").join(stock.select("part_id"), "part_id", "left").select(*lines.columns)
    accepted = ample.unionByName(marked.filter(~F.col("over")).select(*lines.columns))
    return Sold(
        parts=lower_stock(parts, sold_by_part(accepted)),
        accepted=accepted,
        rejects=marked.filter("over").select(
            *lines.columns, "running", "stock_quantity", F.lit(K.INSUFFICIENT_STOCK).alias("reason")
        ),
    )


def sell_one_by_one(
    parts: DataFrame, lines: DataFrame, arrival: Sequence[str], hot_rows: int = HOT_ROWS
) -> Sold:
    """Sell every line as a statement of its own: a refused line leaves its stock to later, smaller lines."""
    judged = admit_lines(parts, lines, arrival, hot_rows)
    accepted = judged.filter("accepted")
    return Sold(
        parts=lower_stock(parts, sold_by_part(accepted)),
        accepted=accepted.select(*lines.columns),
        rejects=judged.filter(~F.col("accepted")).select(
            *lines.columns, F.lit(K.INSUFFICIENT_STOCK).alias("reason")
        ),
    )


def sell_whole_orders(
    parts: DataFrame, lines: DataFrame, hot_rows: int = HOT_ROWS, fold_lines: int = FOLD_LINES
) -> Sold:
    """Sell whole orders one after another, by order_id: an order takes all its parts or none."""
    asked = lines.withColumnRenamed("order_id", "request_id")
    refused = stage(refused_requests(parts, asked, hot_rows, fold_lines).withColumnRenamed("request_id", "order_id"))
    # A line without an order is in no accepted one.
    accepted = lines.filter(F.col("order_id").isNotNull()).join(refused, "order_id", "left_anti")
    return Sold(
        parts=lower_stock(parts, sold_by_part(accepted)),
        accepted=accepted.select(*lines.columns),
        rejects=refused.select("order_id", F.lit(K.INSUFFICIENT_STOCK).alias("reason")),
    )


def return_lines(parts: DataFrame, lines: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take (order_id, part_id) pairs back: stock rises by their quantity, and all their lines go.

    Returns the parts and the lines as they stand afterwards.
    """
    pairs = returns.select("order_id", "part_id").distinct()
    back = lines.join(pairs, ["order_id", "part_id"], "left_semi").groupBy("part_id").agg(
        F.sum("quantity").alias("back")
    )
    raised = (F.col("stock_quantity") + F.coalesce("back", F.lit(0))).cast("int")
    after = parts.join(back, "part_id", "left").withColumn("stock_quantity", raised).select(*parts.columns)
    return after, lines.join(pairs, ["order_id", "part_id"], "left_anti")


def delete_parts(parts: DataFrame, doomed: DataFrame, usage: DataFrame, strict: bool = False) -> Deletion:
    """Delete the listed parts unless an order line uses them.

    Row by row, used parts stay and are reported. In strict mode one used part
    keeps them all, as one deleting statement would.
    """
    listed = doomed.select("part_id").distinct()
    used = usage.select("part_id").distinct()
    blocked = listed.join(used, "part_id", "left_semi").join(parts.select("part_id"), "part_id", "left_semi")
    allowed = listed.join(used, "part_id", "left_anti")
    if strict:
        any_blocked = blocked.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
        allowed = allowed.filter(~any_blocked)
    return Deletion(
        parts=parts.join(allowed, "part_id", "left_anti"),
        blocked=blocked.select("part_id", F.lit(K.PART_IN_USE).alias("reason")),
    )
