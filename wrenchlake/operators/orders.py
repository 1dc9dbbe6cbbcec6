"""Order procedures: recomputing totals, placing orders, adding lines, changing dates.

A procedure returns the table as it would stand afterwards, and its rejects.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.functions.money import cents, from_cents
from wrenchlake.functions.rules import first_reason
from wrenchlake.operators.contention import admit_requests
from wrenchlake.operators.lookups import parts_by_ref, services_by_name
from wrenchlake.operators.ordered import HOT_ROWS, row_numbers
from wrenchlake.operators.pricing import quote_with_quantity
from wrenchlake.operators.references import join_references
from wrenchlake.operators.stock import lower_stock, sold_by_part
from wrenchlake.session import stage
from wrenchlake.sources.schemas import TOTAL


class Added(NamedTuple):
    lines: DataFrame
    rejects: DataFrame


class Placed(NamedTuple):
    orders: DataFrame
    part_lines: DataFrame
    service_lines: DataFrame
    parts: DataFrame
    rejects: DataFrame


def totals_diff(amounts: DataFrame) -> DataFrame:
    """(order_id, old_total, new_total) for every order; the amounts carry total_amount."""
    return amounts.select("order_id", F.col("total_amount").alias("old_total"), F.col("total").alias("new_total"))


def recalculate_all(orders: DataFrame, amounts: DataFrame) -> DataFrame:
    """Orders after every total is recomputed; the amounts carry the other columns of the orders."""
    return amounts.withColumn("total_amount", F.col("total").cast(TOTAL)).select(*orders.columns)


def recalculate_listed(orders: DataFrame, listed_amounts: DataFrame) -> DataFrame:
    """Orders after the totals of some of them are recomputed; the amounts are those of the listed orders."""
    updated = orders.join(listed_amounts, "order_id", "left").withColumn(
        "total_amount", F.coalesce(F.col("total").cast(TOTAL), F.col("total_amount"))
    )
    return updated.select(*orders.columns)


def change_totals(
    orders: DataFrame, part_changes: DataFrame, service_changes: DataFrame, parts: DataFrame, services: DataFrame
) -> DataFrame:
    """Orders after lines came and went: only what changed is priced, and added to the stored totals.

    `part_changes` are (order_id, part_id, quantity), negative for lines that went; `service_changes` (order_id, service_id, lines), lines
    being how many came, negative for those that went. A stored total that was right stays right; an order without a change
    is not touched, and a null total stays null. An unknown or unpriced part or service counts nothing.
    """
    part_prices = parts.select("part_id", cents(F.col("price")).alias("unit"))
    service_prices = services.select("service_id", cents(F.col("price")).alias("unit"))
    # Summed per item before the catalogue is joined.
    by_part = part_changes.groupBy("order_id", "part_id").agg(F.sum("quantity").alias("n")).join(part_prices, "part_id")
    by_service = service_changes.groupBy("order_id", "service_id").agg(F.sum("lines").alias("n"))
    priced = by_part.select("order_id", "unit", "n").unionByName(
        by_service.join(service_prices, "service_id").select("order_id", "unit", "n")
    )
    delta = priced.groupBy("order_id").agg(F.sum(F.col("unit") * F.col("n")).alias("delta"))
    changed = F.col("total_amount") + from_cents(F.coalesce("delta", F.lit(0)))
    return orders.join(delta, "order_id", "left").withColumn("total_amount", changed.cast(TOTAL)).select(*orders.columns)


def update_order_dates(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders after dates are changed through the client-orders view.

    Only the date is written. The match decides, not the value, so a null date is
    written too. Of several changes to one order the last by `seq` stands.
    """
    last = changes.groupBy("order_id").agg(F.max(F.struct("seq", "order_date")).alias("change"))
    updated = orders.join(last, "order_id", "left").withColumn(
        "order_date",
        F.when(F.col("change").isNotNull(), F.col("change.order_date")).otherwise(F.col("order_date")),
    )
    return updated.select(*orders.columns)


PART_LINE_COLUMNS = ["request_id", "pos", "order_id", "part_id", "quantity"]


def _judge(lines: DataFrame, reason: Column) -> DataFrame:
    """Give every line of a request the request's first reason by position.

    The lines of a request come from one row's list, so the group is as small as that list.
    """
    request = Window.partitionBy("request_id")
    failed = F.when(F.col("reason").isNotNull(), F.struct("pos", "reason"))
    return lines.withColumn("reason", reason).withColumn("verdict", F.min(failed).over(request))


def _split(judged: DataFrame, requests: DataFrame, lists: str, columns: list[str]) -> Added:
    null_lists = requests.filter(F.col(lists).isNull()).select("request_id", F.lit(K.NULL_LIST).alias("reason"))
    refused = judged.filter(F.col("verdict").isNotNull() & (F.col("verdict.pos") == F.col("pos"))).select(
        "request_id", "verdict.reason"
    )
    return Added(
        lines=judged.filter(F.col("verdict").isNull()).select(*columns),
        rejects=refused.unionByName(null_lists),
    )


def add_parts_to_orders(requests: DataFrame, parts: DataFrame, judged: DataFrame | None = None) -> Added:
    """(request_id, order_id, parts: array of (manufacturer, part_name, quantity)) → new part lines.

    A request is taken whole or not at all: every part must exist, and its stock
    must cover each line and the request's sum for that part. An unknown (null)
    stock passes. Each request is judged against the given stock, as if it were the only one. A caller that
    has written what `judge_parts` gives for these requests may pass it on.
    """
    return _split(judge_parts(requests, parts) if judged is None else judged, requests, "parts", PART_LINE_COLUMNS)


def judge_parts(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """The lines of the requests with the verdict on their request, as if it were the only one."""
    lines = requests.select("request_id", "order_id", F.posexplode("parts").alias("pos", "line")).select(
        "request_id", "order_id", "pos", "line.manufacturer", "line.part_name", "line.quantity"
    )
    catalog = parts_by_ref(parts).drop("price")
    found = join_references(lines, catalog, ["part_name", "manufacturer"]).repartition("request_id")
    same_part = Window.partitionBy("request_id", "part_id")
    found = found.withColumn("wanted", F.sum("quantity").over(same_part))
    reason = first_reason(
        (F.col("part_id").isNull(), K.PART_NOT_FOUND),
        (F.col("stock_quantity") < F.greatest("quantity", "wanted"), K.INSUFFICIENT_STOCK),
    )
    return _judge(found, reason).select(*PART_LINE_COLUMNS, "verdict")


def add_parts_in_sequence(
    requests: DataFrame, parts: DataFrame, hot_rows: int = HOT_ROWS, judged: DataFrame | None = None
) -> Added:
    """As add_parts_to_orders, but requests come one after another and lower the stock for later ones.

    What the full stock cannot cover no smaller stock can, so the first judgement stands;
    the rest compete in the order of request_id. `judged` is as there.
    """
    # Judged once; the lines and the refusals read what was staged.
    alone = add_parts_to_orders(requests, parts, stage(judge_parts(requests, parts)) if judged is None else judged)
    lines = alone.lines
    admitted = stage(admit_requests(parts, lines.select("request_id", "part_id", "quantity"), hot_rows))
    short = admitted.filter(~F.col("accepted")).select("request_id", F.lit(K.INSUFFICIENT_STOCK).alias("reason"))
    return Added(
        lines=lines.join(admitted.filter("accepted").select("request_id"), "request_id", "left_semi"),
        rejects=alone.rejects.unionByName(short),
    )


def add_services_to_orders(requests: DataFrame, services: DataFrame) -> Added:
    """(request_id, order_id, mechanic_id, services: array of (service_name, quantity)) → new service lines.

    One unknown service refuses the whole request.
    """
    lines = requests.select("request_id", "order_id", "mechanic_id", F.posexplode("services").alias("pos", "line"))
    lines = lines.select("request_id", "order_id", "mechanic_id", "pos", "line.service_name", "line.quantity")
    catalog = services_by_name(services).select("service_name", "service_id")
    found = lines.join(catalog, "service_name", "left")
    reason = first_reason((F.col("service_id").isNull(), K.SERVICE_NOT_FOUND))
    return _split(
        _judge(found, reason),
        requests,
        "services",
        ["request_id", "pos", "order_id", "service_id", "mechanic_id", "quantity"],
    )


def check_order_requests(requests: DataFrame, quotes: DataFrame) -> DataFrame:
    """Order requests with their quoted total and a status.

    Client, car, workplace and payment type must be present and the total positive;
    an order may lack parts or services.
    """
    required = ["client_id", "car_id", "workplace_id", "payment_type_id"]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    priced = requests.join(quotes.select("request_id", "total", F.col("status").alias("quote_status")), "request_id")
    reason = F.when(F.col("quote_status") != K.OK, F.col("quote_status"))
    incomplete = F.when(missing | ~F.coalesce(F.col("total") > 0, F.lit(False)), F.lit(K.MISSING_FIELD))
    return priced.withColumn("status", F.coalesce(reason, incomplete, F.lit(K.OK))).drop("quote_status")


def _pairs(ids: str, quantities: str, key: str) -> Column:
    return F.arrays_zip(F.col(ids).alias(key), F.col(quantities).alias("quantity"))


def _lines(accepted: DataFrame, ids: str, quantities: str, key: str) -> DataFrame:
    return accepted.select("order_id", "mechanic_id", F.inline(_pairs(ids, quantities, key)))


def place_orders(
    requests: DataFrame, orders: DataFrame, parts: DataFrame, services: DataFrame, hot_rows: int = HOT_ROWS
) -> Placed:
    """Quote, check and place whole order requests, one after another by request_id.

    A request whose quote and fields are in order takes all its parts from the stock that the requests before it have left, or is refused;
    a refused request takes nothing. Accepted requests get the next order ids in the order of request_id. The order
    date and the mechanic are inputs, so a rerun places the same orders. Besides the new orders and lines, the
    parts as they stand afterwards come back.
    """
    asked = stage(requests)
    # One verdict per request is staged; all outputs read it.
    checked = stage(check_order_requests(asked, quote_with_quantity(asked, parts, services)))
    in_order = checked.filter(F.col("status") == K.OK)
    wanted = in_order.select("request_id", F.inline(_pairs("part_ids", "part_qty", "part_id")))
    admitted = stage(admit_requests(parts, wanted, hot_rows))
    short = admitted.filter(~F.col("accepted")).select("request_id")
    accepted = row_numbers(in_order.join(short, "request_id", "left_anti"), [], ["request_id"], "nth", hot_rows)
    last_id = orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).alias("last_id"))
    accepted = accepted.withColumn("order_id", last_id.scalar() + F.col("nth"))
    part_lines = _lines(accepted, "part_ids", "part_qty", "part_id").select("order_id", "part_id", "quantity")
    refused = checked.filter(F.col("status") != K.OK).select("request_id", F.col("status").alias("reason"))
    return Placed(
        orders=accepted.select(
            "order_id",
            "client_id",
            "car_id",
            "workplace_id",
            "order_date",
            "payment_type_id",
            F.col("total").cast(TOTAL).alias("total_amount"),
        ),
        part_lines=part_lines,
        service_lines=_lines(accepted, "service_ids", "service_qty", "service_id").select(
            "order_id", "service_id", "mechanic_id", "quantity"
        ),
        parts=lower_stock(parts, sold_by_part(part_lines)),
        rejects=refused.unionByName(short.withColumn("reason", F.lit(K.INSUFFICIENT_STOCK))),
    )
