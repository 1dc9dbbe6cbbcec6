"""Price totals for whole tables of requests and for stored orders.

Each request is one row holding short lists. Lists are exploded, priced by one
join with the catalogue, and summed by one aggregation on the request key, so a
list never needs a loop and a popular catalogue row never gathers its requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.functions.money import cents, from_cents
from wrenchlake.functions.rules import is_filled
from wrenchlake.operators.lookups import parts_by_ref, services_by_name
from wrenchlake.operators.references import join_references

QUOTE = "decimal(10,2)"
#: Listed orders that are broadcast at most.
SHORT_LIST = 100_000


def _no_reason() -> Column:
    return F.lit(None).cast("string")


def _price_by_id(requests: DataFrame, ids: str, catalog: DataFrame, key: str, reason: str) -> DataFrame:
    """Priced elements of an id list; an unknown or unpriced id carries the reason."""
    elements = requests.select("request_id", F.posexplode_outer(ids).alias("pos", key))
    prices = catalog.select(key, cents(F.col("price")).alias("amount"))
    missing = F.col("pos").isNotNull() & F.col("amount").isNull()
    return elements.join(prices, key, "left").select(
        "request_id", "amount", F.when(missing, F.lit(reason)).alias("reason")
    )


def _price_parts_by_ref(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """Priced elements of a (name, maker) list; an unknown one counts nothing, an unpriced one fails."""
    elements = requests.select("request_id", F.explode_outer("parts").alias("part")).select(
        "request_id", "part.part_name", "part.manufacturer"
    )
    prices = parts_by_ref(parts).select("part_name", "manufacturer", "part_id", cents(F.col("price")).alias("amount"))
    unpriced = F.col("part_id").isNotNull() & F.col("amount").isNull()
    return join_references(elements, prices, ["part_name", "manufacturer"]).select(
        "request_id", "amount", F.when(unpriced, F.lit(K.PART_NOT_FOUND)).alias("reason")
    )


def _price_services_by_name(requests: DataFrame, services: DataFrame) -> DataFrame:
    elements = requests.select("request_id", F.explode_outer("service_names").alias("service_name"))
    prices = services_by_name(services).select("service_name", "service_id", cents(F.col("price")).alias("amount"))
    unpriced = F.col("service_id").isNotNull() & F.col("amount").isNull()
    return elements.join(prices, "service_name", "left").select(
        "request_id", "amount", F.when(unpriced, F.lit(K.SERVICE_NOT_FOUND)).alias("reason")
    )


def _null_list_lines(requests: DataFrame, *lists: str) -> DataFrame:
    is_null = F.lit(False)
    for name in lists:
        is_null = is_null | F.col(name).isNull()
    return requests.filter(is_null).select(
        "request_id", F.lit(None).cast("long").alias("amount"), F.lit(K.NULL_LIST).alias("reason")
    )


def _totals(lines: DataFrame, strict: bool) -> DataFrame:
    """Sum the priced lines per request; any reason voids the total and becomes the status."""
    summed = lines.groupBy("request_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.min("reason").alias("reason")
    )
    total = F.when(F.col("reason").isNull(), from_cents(F.col("amount"), QUOTE))
    if strict:
        total = F.when(F.col("reason").isNull(), from_cents(F.col("amount"), QUOTE)).otherwise(
            F.raise_error(F.col("reason")).cast(QUOTE)
        )
    return summed.select("request_id", total.alias("total"), F.coalesce("reason", F.lit(K.OK)).alias("status"))


def parts_price_by_ids(requests: DataFrame, parts: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, part_ids) → total; repeats count each time, any miss voids the total."""
    lines = _price_by_id(requests, "part_ids", parts, "part_id", K.PART_NOT_FOUND)
    return _totals(lines.unionByName(_null_list_lines(requests, "part_ids")), strict)


def services_price_by_ids(requests: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_ids) → total, as parts_price_by_ids."""
    lines = _price_by_id(requests, "service_ids", services, "service_id", K.SERVICE_NOT_FOUND)
    return _totals(lines.unionByName(_null_list_lines(requests, "service_ids")), strict)


def parts_price_by_names(requests: DataFrame, parts: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, parts) → total over the parts found; misses count nothing."""
    lines = _price_parts_by_ref(requests, parts)
    return _totals(lines.unionByName(_null_list_lines(requests, "parts")), strict)


def services_price_by_names(requests: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_names) → total over the services found."""
    lines = _price_services_by_name(requests, services)
    return _totals(lines.unionByName(_null_list_lines(requests, "service_names")), strict)


def quote_by_ids(requests: DataFrame, parts: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_ids, part_ids) → total; an empty or null list is skipped, a miss voids it."""
    part_lines = _price_by_id(requests, "part_ids", parts, "part_id", K.PART_NOT_FOUND)
    service_lines = _price_by_id(
        requests.filter(is_filled(F.col("service_ids"))), "service_ids", services, "service_id", K.SERVICE_NOT_FOUND
    )
    return _totals(part_lines.unionByName(service_lines), strict)


def quote_by_names(requests: DataFrame, parts: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_names, parts) → total over everything found; a null list voids it."""
    lines = _price_parts_by_ref(requests, parts).unionByName(_price_services_by_name(requests, services))
    return _totals(lines.unionByName(_null_list_lines(requests, "parts", "service_names")), strict)


def _price_with_quantity(
    requests: DataFrame, ids: str, quantities: str, catalog: DataFrame, key: str, reason: str
) -> DataFrame:
    pairs = F.explode_outer(F.arrays_zip(F.col(ids).alias("id"), F.col(quantities).alias("quantity")))
    elements = requests.select("request_id", pairs.alias("pair")).select(
        "request_id", F.col("pair").isNotNull().alias("present"), F.col("pair.id").alias(key), "pair.quantity"
    )
    prices = catalog.select(key, cents(F.col("price")).alias("unit"))
    why = F.when(F.col("present") & F.col("unit").isNull(), F.lit(reason)).when(
        F.col("present") & F.col("quantity").isNull(), F.lit(K.MISSING_FIELD)
    )
    return elements.join(prices, key, "left").select(
        "request_id", (F.col("unit") * F.col("quantity")).alias("amount"), why.alias("reason")
    )


def quote_with_quantity(requests: DataFrame, parts: DataFrame, services: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, service_ids, service_qty, part_ids, part_qty) → Σ price × quantity on both sides.

    Ids and quantities are parallel lists; a list longer than its partner voids the total.
    """
    part_lines = _price_with_quantity(requests, "part_ids", "part_qty", parts, "part_id", K.PART_NOT_FOUND)
    service_lines = _price_with_quantity(
        requests, "service_ids", "service_qty", services, "service_id", K.SERVICE_NOT_FOUND
    )
    return _totals(part_lines.unionByName(service_lines), strict)


def order_amounts(
    orders: DataFrame,
    parts_in_orders: DataFrame,
    services_in_orders: DataFrame,
    parts: DataFrame,
    services: DataFrame,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every stored order with its recomputed total: Σ part price × quantity + Σ service price.

    The quantity of a service line does not count. Part lines, service lines and
    orders meet in one union and one aggregation on order_id: no join between the
    two line tables can fan out, and map-side sums absorb an order with many lines.
    Order columns named in `carry` come along, so no join back to the orders is needed.
    """

    lines = _amount_lines(orders, parts_in_orders, services_in_orders, parts, services, carry)
    return (
        lines.groupBy("order_id")
        # An order is stored once, so the largest value of a carried column is its only one.
        .agg(F.sum("amount").alias("amount"), F.max("stored").alias("stored"), *[F.max(c).alias(c) for c in carry])
        .filter("stored")
        .select("order_id", *carry, from_cents(F.col("amount")).alias("total"))
    )


def _amount_lines(
    orders: DataFrame,
    parts_in_orders: DataFrame,
    services_in_orders: DataFrame,
    parts: DataFrame,
    services: DataFrame,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(order_id, amount in cents, stored, carry…): the priced lines, and a row of nothing for each stored order."""

    def line(amount: Column) -> list[Column]:
        nothing = [F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in carry]
        return [F.col("order_id"), amount.alias("amount"), F.lit(False).alias("stored"), *nothing]

    part_prices = parts.select("part_id", cents(F.col("price")).alias("unit"))
    service_prices = services.select("service_id", cents(F.col("price")).alias("unit"))
    spent_on_parts = parts_in_orders.join(part_prices, "part_id").select(*line(F.col("unit") * F.col("quantity")))
    spent_on_services = services_in_orders.join(service_prices, "service_id").select(*line(F.col("unit")))
    stored = orders.select(
        "order_id", F.lit(0).cast("long").alias("amount"), F.lit(True).alias("stored"), *carry
    )
    return spent_on_parts.unionByName(spent_on_services).unionByName(stored)


def order_amounts_of(
    ids: DataFrame,
    orders: DataFrame,
    parts_in_orders: DataFrame,
    services_in_orders: DataFrame,
    parts: DataFrame,
    services: DataFrame,
) -> DataFrame:
    """order_amounts of the listed orders alone.

    Of a short list other lines are dropped, by a broadcast, before anything is priced. A long list is one more source of the
    aggregation on the order id, and unlisted orders are left out after it: to drop their lines first, a task would have to sort
    the millions of rows that a shuffle partition of ids in order holds, of each table apart.
    """
    wanted = ids.select("order_id").distinct()
    if wanted.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        kept = [df.join(F.broadcast(wanted), "order_id", "left_semi") for df in (orders, parts_in_orders, services_in_orders)]
        return order_amounts(*kept, parts, services)
    lines = _amount_lines(orders, parts_in_orders, services_in_orders, parts, services).withColumn("listed", F.lit(False))
    listed = ids.select(
        "order_id", F.lit(0).cast("long").alias("amount"), F.lit(False).alias("stored"), F.lit(True).alias("listed")
    )
    return (
        lines.unionByName(listed)
        .groupBy("order_id")
        .agg(F.sum("amount").alias("amount"), F.max("stored").alias("stored"), F.max("listed").alias("listed"))
        # A null id equals no other one.
        .filter(F.col("stored") & F.col("listed") & F.col("order_id").isNotNull())
        .select("order_id", from_cents(F.col("amount")).alias("total"))
    )


def totals_for_ids(ids: DataFrame, amounts: DataFrame) -> DataFrame:
    """Totals of requested order ids; an id that is not stored is worth 0."""
    return ids.join(amounts, "order_id", "left").select(
        "order_id", F.coalesce("total", F.lit(0).cast("decimal(20,2)")).alias("total")
    )
