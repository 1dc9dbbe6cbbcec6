"""Lookups, quotes, order totals and the order procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.operators import lookups, orders, pricing, stock
from wrenchlake.querybook.base import ORDER_COLUMNS, Query, fold_steps, query, recursive, sql
from wrenchlake.sources import requests
from wrenchlake.sources.starmap import star_shop
from wrenchlake.sources.tables import Shop

PICKS_SQL = """
picks AS (
  SELECT o_orderkey AS request_id, o_custkey AS c, cast(substring(o_orderpriority, 1, 1) AS int) AS d,
         cast(o_orderdate AS date) AS order_date, month(o_orderdate) AS mo,
         cast(strpos('FOP', o_orderstatus) AS bigint) AS payment_type_id,
         p_name AS n, p_brand AS m, s.service_name AS sn, s.service_id AS s
  FROM orders JOIN part ON o_custkey = p_partkey JOIN sv_services s ON s.service_name = p_type)"""

# One row per list element: which requests (d), at which position, which id and how many.
ID_LISTS_SQL = f"""{PICKS_SQL},
part_elements AS (
  SELECT request_id, pos, c + shift AS part_id, coalesce(q, mo) AS quantity
  FROM picks JOIN (VALUES (1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 0, 3), (2, 0, 0, 4), (2, 1, 1000000000, 5),
                          (5, 0, 1, NULL)) v(vd, pos, shift, q) ON d = vd),
service_elements AS (
  SELECT request_id, pos, CASE WHEN known THEN s ELSE -1 END AS service_id, coalesce(q, mo) AS quantity
  FROM picks JOIN (VALUES (1, 0, true, 1), (2, 0, true, 2), (2, 1, true, 3), (3, 0, true, NULL), (5, 0, true, 1),
                          (5, 1, false, 1)) v(vd, pos, known, q) ON d = vd),
part_prices AS (
  SELECT e.request_id, sum(p.price) AS price, sum(p.price * e.quantity) AS amount,
         count(*) - count(p.price) AS misses
  FROM part_elements e LEFT JOIN sv_parts p ON p.part_id = e.part_id GROUP BY e.request_id),
service_prices AS (
  SELECT e.request_id, sum(s.price) AS price, sum(s.price * e.quantity) AS amount,
         count(*) - count(s.price) AS misses
  FROM service_elements e LEFT JOIN sv_services s ON s.service_id = e.service_id GROUP BY e.request_id),
priced AS (
  SELECT k.request_id, k.c, k.d, k.order_date, k.payment_type_id,
         coalesce(p.price, 0) AS part_price, coalesce(p.amount, 0) AS part_amount,
         coalesce(p.misses, 0) AS part_misses, coalesce(s.price, 0) AS service_price,
         coalesce(s.amount, 0) AS service_amount, coalesce(s.misses, 0) AS service_misses
  FROM picks k LEFT JOIN part_prices p ON p.request_id = k.request_id
  LEFT JOIN service_prices s ON s.request_id = k.request_id)"""

NAME_LISTS_SQL = f"""{PICKS_SQL},
ref_elements AS (
  SELECT request_id, pos, CASE WHEN known_part THEN n ELSE 'no such part' END AS part_name,
         CASE WHEN known_maker THEN m ELSE 'no such maker' END AS manufacturer
  FROM picks JOIN (VALUES (1, 0, true, true), (1, 1, true, true), (2, 0, true, true), (2, 1, false, true),
                          (4, 0, true, false)) v(vd, pos, known_part, known_maker) ON d = vd),
name_elements AS (
  SELECT request_id, pos, CASE WHEN known THEN sn ELSE 'no such service' END AS service_name
  FROM picks JOIN (VALUES (1, 0, true), (2, 0, true), (2, 1, false), (3, 0, true), (3, 1, true), (5, 0, false))
                  v(vd, pos, known) ON d = vd),
refs AS (SELECT part_name, manufacturer, min(part_id) AS part_id FROM sv_parts GROUP BY part_name, manufacturer),
names AS (SELECT service_name, min(service_id) AS service_id FROM sv_services GROUP BY service_name),
found_parts AS (
  SELECT e.request_id, e.pos, r.part_id, e.part_name, e.manufacturer
  FROM ref_elements e JOIN refs r ON r.part_name = e.part_name AND r.manufacturer = e.manufacturer),
found_services AS (
  SELECT e.request_id, e.pos, e.service_name, n.service_id
  FROM name_elements e JOIN names n ON n.service_name = e.service_name),
ref_prices AS (
  SELECT f.request_id, sum(p.price) AS price FROM found_parts f JOIN sv_parts p ON p.part_id = f.part_id
  GROUP BY f.request_id),
name_prices AS (
  SELECT f.request_id, sum(s.price) AS price FROM found_services f JOIN sv_services s ON s.service_id = f.service_id
  GROUP BY f.request_id)"""

TOTALS_SQL = """
totals AS (
  SELECT order_id, total_amount, cast(coalesce(
           (SELECT sum(p.price * l.quantity) FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id
            WHERE l.order_id = o.order_id), 0) + coalesce(
           (SELECT sum(s.price) FROM sv_services_in_orders l JOIN sv_services s ON s.service_id = l.service_id
            WHERE l.order_id = o.order_id), 0) AS double) AS total
  FROM sv_orders o)"""

_ONLY_PARTS = """SELECT request_id,
  CASE WHEN d <> 4 AND part_misses = 0 THEN cast(part_price AS double) END AS total,
  CASE WHEN d = 4 THEN 'null_list' WHEN part_misses > 0 THEN 'part_not_found' ELSE 'ok' END AS status
FROM priced"""
_ONLY_SERVICES = """SELECT request_id, CASE WHEN service_misses = 0 THEN cast(service_price AS double) END AS total,
  CASE WHEN service_misses > 0 THEN 'service_not_found' ELSE 'ok' END AS status FROM priced"""
STATUS = (
    "CASE WHEN part_misses > 0 THEN 'part_not_found' WHEN service_misses > 0 THEN 'service_not_found' ELSE 'ok' END"
)

# Requests as the order procedure judges them.
JUDGED_SQL = f"""{ID_LISTS_SQL},
judged AS (
  SELECT request_id, c AS client_id, CASE WHEN payment_type_id <> 3 THEN c * 10 + d END AS car_id,
         cast(d AS bigint) AS workplace_id, order_date, payment_type_id, c AS mechanic_id,
         part_amount + service_amount AS total,
         CASE WHEN {STATUS} <> 'ok' THEN {STATUS}
              WHEN payment_type_id = 3 OR part_amount + service_amount <= 0 THEN 'missing_field' ELSE 'ok' END AS status
  FROM priced)"""

# The accepted requests take their parts one after another; one that the stock left cannot cover takes nothing.
PLACED_SQL = f"""{JUDGED_SQL},{
    fold_steps("SELECT request_id AS turn, part_id, quantity FROM part_elements JOIN judged USING (request_id) WHERE status = 'ok'")
},
short_requests AS (SELECT turn AS request_id FROM taking WHERE turn IS NOT NULL AND NOT granted),
placed AS (
  SELECT *, (SELECT max(order_id) FROM sv_orders) + row_number() OVER (ORDER BY request_id) AS order_id
  FROM judged WHERE status = 'ok' AND request_id NOT IN (SELECT request_id FROM short_requests))"""

PART_REQUEST_STEPS = """
wanted AS (
  SELECT request_id, pos, CASE WHEN known THEN n ELSE 'no such part' END AS part_name, m AS manufacturer,
         mo * times + plus AS quantity
  FROM picks JOIN (VALUES (1, 0, true, 1, 0), (1, 1, true, 1, 1), (2, 0, true, 1, 0), (2, 1, false, 1, 0),
                          (3, 0, true, 200, 0), (4, 0, true, 60, 0), (4, 1, true, 60, 0))
                  v(vd, pos, known, times, plus) ON d = vd),
matched AS (
  SELECT w.*, p.part_id, p.stock_quantity, sum(w.quantity) OVER (PARTITION BY w.request_id, p.part_id) AS together
  FROM wanted w LEFT JOIN (
    SELECT part_id, part_name, manufacturer, stock_quantity FROM sv_parts
    QUALIFY row_number() OVER (PARTITION BY part_name, manufacturer ORDER BY part_id) = 1) p
  ON p.part_name = w.part_name AND p.manufacturer = w.manufacturer),
reasons AS (
  SELECT *, CASE WHEN part_id IS NULL THEN 'part_not_found'
                 WHEN together > stock_quantity THEN 'insufficient_stock' END AS reason FROM matched),
refused AS (SELECT request_id, arg_min(reason, pos) AS reason FROM reasons WHERE reason IS NOT NULL GROUP BY request_id)"""

SERVICE_REQUEST_STEPS = """
service_wanted AS (
  SELECT request_id, c AS mechanic_id, pos, CASE WHEN known THEN sn ELSE 'no such service' END AS service_name,
         coalesce(q, mo) AS quantity
  FROM picks JOIN (VALUES (1, 0, true, NULL), (2, 0, true, 1), (2, 1, false, 1), (3, 0, true, 1), (3, 1, true, 2))
                  v(vd, pos, known, q) ON d = vd),
service_matched AS (
  SELECT w.*, s.service_id FROM service_wanted w LEFT JOIN sv_services s ON s.service_name = w.service_name)"""


def amounts(spark: SparkSession, sf_dir: str, *carry: str):
    shop = star_shop(spark, sf_dir)
    return pricing.order_amounts(
        shop.orders, shop.parts_in_orders, shop.services_in_orders, shop.parts, shop.services, carry
    )


def _recalculated(spark: SparkSession, sf_dir: str):
    stored = star_shop(spark, sf_dir).orders
    return orders.recalculate_all(stored, amounts(spark, sf_dir, *[c for c in stored.columns if c != "order_id"]))


def recalculated_ids(spark: SparkSession, sf_dir: str):
    """Ids of open orders, and as many ids that are not stored."""
    ids = star_shop(spark, sf_dir).orders.filter(F.col("payment_type_id") == 2).select("order_id")
    return ids.unionByName(ids.select((F.col("order_id") + requests.FAR).alias("order_id")))


def listed_amounts(spark: SparkSession, sf_dir: str):
    shop = star_shop(spark, sf_dir)
    return pricing.order_amounts_of(
        recalculated_ids(spark, sf_dir),
        shop.orders,
        shop.parts_in_orders,
        shop.services_in_orders,
        shop.parts,
        shop.services,
    )


def _line_changes(spark: SparkSession, sf_dir: str):
    """Parts and services that are added to orders, and part lines that are taken back, as signed lines."""
    shop = star_shop(spark, sf_dir)
    back = shop.parts_in_orders.join(
        requests.returned_pairs(spark, sf_dir).distinct(), ["order_id", "part_id"], "left_semi"
    ).withColumn("quantity", -F.col("quantity"))
    new_parts = added_parts(spark, sf_dir).lines.select(*back.columns)
    new_services = added_services(spark, sf_dir).lines.select("order_id", "service_id", F.lit(1).alias("lines"))
    return new_parts.unionByName(back), new_services


def _totals_after_changes(spark: SparkSession, sf_dir: str):
    shop = star_shop(spark, sf_dir)
    return orders.change_totals(
        _recalculated(spark, sf_dir), *_line_changes(spark, sf_dir), shop.parts, shop.services
    )


def placed(spark: SparkSession, sf_dir: str, shop: Shop | None = None, picks: DataFrame | None = None) -> orders.Placed:
    shop = shop or star_shop(spark, sf_dir)
    asked = requests.order_requests(spark, sf_dir, picks)
    return orders.place_orders(asked, shop.orders, shop.parts, shop.services)


def added_parts(spark: SparkSession, sf_dir: str) -> orders.Added:
    return orders.add_parts_to_orders(requests.part_order_requests(spark, sf_dir), star_shop(spark, sf_dir).parts)


def added_in_sequence(spark: SparkSession, sf_dir: str) -> orders.Added:
    return orders.add_parts_in_sequence(requests.part_order_requests(spark, sf_dir), star_shop(spark, sf_dir).parts)


def added_services(
    spark: SparkSession, sf_dir: str, shop: Shop | None = None, picks: DataFrame | None = None
) -> orders.Added:
    shop = shop or star_shop(spark, sf_dir)
    return orders.add_services_to_orders(requests.service_order_requests(spark, sf_dir, picks), shop.services)


def _checked(spark: SparkSession, sf_dir: str):
    shop = star_shop(spark, sf_dir)
    asked = requests.order_requests(spark, sf_dir)
    quotes = pricing.quote_with_quantity(asked, shop.parts, shop.services)
    checked = orders.check_order_requests(asked, quotes)
    return checked.select("request_id", "total", "status")


QUERIES: list[Query] = [
    query(
        "lookup_part_ids",
        lambda s, d: lookups.lookup_part_ids(requests.part_refs(s, d), star_shop(s, d).parts),
        sql(
            """SELECT k.request_id, k.part_name, k.manufacturer, min(p.part_id) AS part_id,
                      CASE WHEN min(p.part_id) IS NULL THEN 'part_not_found' ELSE 'ok' END AS status
               FROM (SELECT request_id, CASE WHEN d = 2 THEN 'no such part' ELSE n END AS part_name, m AS manufacturer
                     FROM picks) k
               LEFT JOIN sv_parts p ON p.part_name = k.part_name AND p.manufacturer = k.manufacturer
               GROUP BY k.request_id, k.part_name, k.manufacturer""",
            PICKS_SQL,
        ),
    ),
    query(
        "lookup_service_ids",
        lambda s, d: lookups.lookup_service_ids(requests.service_refs(s, d), star_shop(s, d).services),
        sql(
            """SELECT k.request_id, k.service_name, s.service_id,
                      CASE WHEN s.service_id IS NULL THEN 'service_not_found' ELSE 'ok' END AS status
               FROM (SELECT request_id, CASE WHEN d = 5 THEN 'no such service' ELSE sn END AS service_name FROM picks) k
               LEFT JOIN sv_services s ON s.service_name = k.service_name""",
            PICKS_SQL,
        ),
    ),
    query(
        "resolve_part_list",
        lambda s, d: lookups.resolve_part_list(requests.name_requests(s, d), star_shop(s, d).parts).found,
        sql(
            "SELECT request_id, cast(pos AS bigint) AS pos, part_id, part_name, manufacturer FROM found_parts",
            NAME_LISTS_SQL,
        ),
    ),
    query(
        "resolve_service_list",
        lambda s, d: lookups.resolve_service_list(requests.name_requests(s, d), star_shop(s, d).services).found,
        sql(
            "SELECT request_id, cast(pos AS bigint) AS pos, service_name, service_id FROM found_services",
            NAME_LISTS_SQL,
        ),
    ),
    query(
        "parts_price_by_ids",
        lambda s, d: pricing.parts_price_by_ids(requests.id_requests(s, d), star_shop(s, d).parts),
        sql(_ONLY_PARTS, ID_LISTS_SQL),
    ),
    query(
        "services_price_by_ids",
        lambda s, d: pricing.services_price_by_ids(requests.id_requests(s, d), star_shop(s, d).services),
        sql(_ONLY_SERVICES, ID_LISTS_SQL),
    ),
    query(
        "parts_price_by_names",
        lambda s, d: pricing.parts_price_by_names(requests.name_requests(s, d), star_shop(s, d).parts),
        sql(
            """SELECT k.request_id, CASE WHEN d <> 5 THEN cast(coalesce(r.price, 0) AS double) END AS total,
                      CASE WHEN d = 5 THEN 'null_list' ELSE 'ok' END AS status
               FROM picks k LEFT JOIN ref_prices r ON r.request_id = k.request_id""",
            NAME_LISTS_SQL,
        ),
    ),
    query(
        "services_price_by_names",
        lambda s, d: pricing.services_price_by_names(requests.name_requests(s, d), star_shop(s, d).services),
        sql(
            """SELECT k.request_id, cast(coalesce(n.price, 0) AS double) AS total, 'ok' AS status
               FROM picks k LEFT JOIN name_prices n ON n.request_id = k.request_id""",
            NAME_LISTS_SQL,
        ),
    ),
    query(
        "quote_by_ids",
        lambda s, d: pricing.quote_by_ids(requests.id_requests(s, d), star_shop(s, d).parts, star_shop(s, d).services),
        sql(
            f"""SELECT request_id, CASE WHEN part_misses + service_misses = 0
                                        THEN cast(part_price + service_price AS double) END AS total,
                       {STATUS} AS status FROM priced""",
            ID_LISTS_SQL,
        ),
    ),
    query(
        "quote_by_names",
        lambda s, d: pricing.quote_by_names(
            requests.name_requests(s, d), star_shop(s, d).parts, star_shop(s, d).services
        ),
        sql(
            """SELECT k.request_id,
                      CASE WHEN d <> 5 THEN cast(coalesce(r.price, 0) + coalesce(n.price, 0) AS double) END AS total,
                      CASE WHEN d = 5 THEN 'null_list' ELSE 'ok' END AS status
               FROM picks k LEFT JOIN ref_prices r ON r.request_id = k.request_id
               LEFT JOIN name_prices n ON n.request_id = k.request_id""",
            NAME_LISTS_SQL,
        ),
    ),
    query(
        "quote_with_quantity",
        lambda s, d: pricing.quote_with_quantity(
            requests.id_requests(s, d), star_shop(s, d).parts, star_shop(s, d).services
        ),
        sql(
            f"""SELECT request_id, CASE WHEN part_misses + service_misses = 0
                                        THEN cast(part_amount + service_amount AS double) END AS total,
                       {STATUS} AS status FROM priced""",
            ID_LISTS_SQL,
        ),
    ),
    query(
        "check_availability",
        lambda s, d: stock.check_availability(requests.availability_requests(s, d), star_shop(s, d).parts),
        sql(
            """SELECT request_id, k.part_id, cast(k.quantity AS bigint) AS quantity,
                      coalesce(p.stock_quantity >= k.quantity, false) AS available
               FROM (SELECT request_id, CASE WHEN d = 2 THEN c + 1000000000 ELSE c END AS part_id,
                            CASE WHEN d <> 4 THEN mo * 100 END AS quantity FROM picks) k
               LEFT JOIN sv_parts p ON p.part_id = k.part_id""",
            PICKS_SQL,
        ),
    ),
    query("order_totals", lambda s, d: amounts(s, d), sql("SELECT order_id, total FROM totals", TOTALS_SQL)),
    query(
        "order_totals_for_ids",
        lambda s, d: pricing.totals_for_ids(recalculated_ids(s, d), listed_amounts(s, d)),
        sql(
            """SELECT order_id, total FROM totals WHERE order_id IN
                 (SELECT order_id FROM sv_orders WHERE payment_type_id = 2)
               UNION ALL
               SELECT order_id + 1000000000, 0.0 FROM sv_orders WHERE payment_type_id = 2""",
            TOTALS_SQL,
        ),
    ),
    query(
        "recalc_totals_diff",
        lambda s, d: orders.totals_diff(amounts(s, d, "total_amount")),
        sql(
            "SELECT order_id, cast(total_amount AS double) AS old_total, total AS new_total FROM totals", TOTALS_SQL
        ),
    ),
    query(
        "recalc_totals_by_ids",
        lambda s, d: orders.recalculate_listed(star_shop(s, d).orders, listed_amounts(s, d)),
        sql(
            """SELECT o.order_id, client_id, car_id, workplace_id, order_date, payment_type_id,
                      CASE WHEN payment_type_id = 2 THEN t.total ELSE cast(o.total_amount AS double) END AS total_amount
               FROM sv_orders o JOIN totals t ON t.order_id = o.order_id""",
            TOTALS_SQL,
        ),
    ),
    query(
        "recalc_totals_all",
        _recalculated,
        sql(
            """SELECT o.order_id, client_id, car_id, workplace_id, order_date, payment_type_id, t.total AS total_amount
               FROM sv_orders o JOIN totals t ON t.order_id = o.order_id""",
            TOTALS_SQL,
        ),
    ),
    query(
        "recalc_totals_after_changes",
        _totals_after_changes,
        sql(
            """SELECT order_id, client_id, car_id, workplace_id, order_date, payment_type_id, cast(
                      coalesce((SELECT sum(p.price * l.quantity) FROM parts_after l JOIN sv_parts p ON p.part_id = l.part_id
                                WHERE l.order_id = o.order_id), 0)
                      + coalesce((SELECT sum(s.price) FROM services_after l JOIN sv_services s ON s.service_id = l.service_id
                                  WHERE l.order_id = o.order_id), 0) AS double) AS total_amount
               FROM sv_orders o""",
            PICKS_SQL
            + ","
            + PART_REQUEST_STEPS
            + ","
            + SERVICE_REQUEST_STEPS
            + """,
parts_after AS (
  SELECT order_id, part_id, quantity FROM sv_parts_in_orders
  WHERE (order_id, part_id) NOT IN (
    SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R')
  UNION ALL
  SELECT request_id, part_id, quantity FROM reasons WHERE request_id NOT IN (SELECT request_id FROM refused)),
services_after AS (
  SELECT order_id, service_id FROM sv_services_in_orders
  UNION ALL
  SELECT request_id, service_id FROM service_matched
  WHERE request_id NOT IN (SELECT request_id FROM service_matched WHERE service_id IS NULL))""",
        ),
    ),
    query(
        "validate_order_requests",
        _checked,
        sql(
            """SELECT request_id, CASE WHEN status IN ('ok', 'missing_field') THEN cast(total AS double) END AS total,
                      status FROM judged""",
            JUDGED_SQL,
        ),
    ),
    query(
        "place_orders",
        lambda s, d: placed(s, d).orders,
        recursive(
            f"SELECT {ORDER_COLUMNS.replace('total_amount AS double', 'total AS double')} FROM placed", PLACED_SQL
        ),
    ),
    query(
        "place_orders_part_lines",
        lambda s, d: placed(s, d).part_lines,
        recursive(
            """SELECT p.order_id, e.part_id, cast(e.quantity AS bigint) AS quantity
               FROM placed p JOIN part_elements e ON e.request_id = p.request_id""",
            PLACED_SQL,
        ),
    ),
    query(
        "place_orders_service_lines",
        lambda s, d: placed(s, d).service_lines,
        recursive(
            """SELECT p.order_id, e.service_id, p.mechanic_id, cast(e.quantity AS bigint) AS quantity
               FROM placed p JOIN service_elements e ON e.request_id = p.request_id""",
            PLACED_SQL,
        ),
    ),
    query(
        "place_orders_parts_after",
        lambda s, d: placed(s, d).parts,
        recursive(
            """SELECT p.part_id, p.part_name, p.manufacturer, cast(p.price AS double) AS price,
                      (SELECT arg_max(stock, k) FROM taking)[i] AS stock_quantity
               FROM sv_parts p JOIN stocked s USING (part_id)""",
            PLACED_SQL,
        ),
    ),
    query(
        "place_orders_rejects",
        lambda s, d: placed(s, d).rejects,
        recursive(
            """SELECT request_id, status AS reason FROM judged WHERE status <> 'ok'
               UNION ALL SELECT request_id, 'insufficient_stock' FROM short_requests""",
            PLACED_SQL,
        ),
    ),
    query(
        "add_parts_to_orders",
        lambda s, d: added_parts(s, d).lines,
        sql(
            """SELECT request_id, cast(pos AS bigint) AS pos, request_id AS order_id, part_id,
                      cast(quantity AS bigint) AS quantity
               FROM reasons WHERE request_id NOT IN (SELECT request_id FROM refused)""",
            PICKS_SQL + "," + PART_REQUEST_STEPS,
        ),
    ),
    query(
        "add_parts_to_orders_rejects",
        lambda s, d: added_parts(s, d).rejects,
        sql(
            """SELECT request_id, reason FROM refused
               UNION ALL SELECT request_id, 'null_list' FROM picks WHERE d = 5""",
            PICKS_SQL + "," + PART_REQUEST_STEPS,
        ),
    ),
    query(
        "add_parts_in_sequence",
        lambda s, d: added_in_sequence(s, d).lines,
        sql(
            """SELECT request_id, cast(pos AS bigint) AS pos, request_id AS order_id, part_id,
                      cast(quantity AS bigint) AS quantity
               FROM reasons WHERE request_id IN (SELECT turn FROM taking WHERE granted)""",
            PICKS_SQL
            + ","
            + PART_REQUEST_STEPS
            + ","
            + fold_steps(
                """SELECT request_id AS turn, part_id, quantity FROM reasons
                   WHERE request_id NOT IN (SELECT request_id FROM refused)"""
            ),
        ).replace("WITH", "WITH RECURSIVE", 1),
    ),
    query(
        "add_services_to_orders",
        lambda s, d: added_services(s, d).lines,
        sql(
            """SELECT request_id, cast(pos AS bigint) AS pos, request_id AS order_id, service_id, mechanic_id,
                      cast(quantity AS bigint) AS quantity
               FROM service_matched
               WHERE request_id NOT IN (SELECT request_id FROM service_matched WHERE service_id IS NULL)""",
            PICKS_SQL + "," + SERVICE_REQUEST_STEPS,
        ),
    ),
]
