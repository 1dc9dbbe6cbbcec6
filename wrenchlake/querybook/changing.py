"""Edits, contacts, cars, mechanics, stock and the report of everything refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.operators import cars, checks, contacts, edits, lookups, mechanics, orders, rejects, saving, stock
from wrenchlake.operators import pricing as prices
from wrenchlake.plans import views
from wrenchlake.querybook import pricing
from wrenchlake.querybook.base import PART_COLUMNS, SEED, Query, fold_steps, query, recursive, sql
from wrenchlake.querybook.viewing import TYPED_SQL
from wrenchlake.session import new_shared_folder, stage
from wrenchlake.sources import requests
from wrenchlake.sources.starmap import star_shop
from wrenchlake.sources.tables import Shop
from wrenchlake.streaming import stock_stream


#: Batches of the streamed sales.
STREAM_BATCHES = 3


def _appended(s: SparkSession, d: str) -> contacts.Appended:
    return contacts.append_clients(requests.client_requests(s, d), star_shop(s, d).clients)


def _phones(s: SparkSession, d: str) -> contacts.Changed:
    return contacts.update_phones(requests.phone_changes(s, d), star_shop(s, d).clients)


def _edited(s: SparkSession, d: str, strict: bool = False) -> edits.Edited:
    return edits.apply_edits(star_shop(s, d).clients, requests.client_edits(s, d), "client_id", strict)


def _guarded(s: SparkSession, d: str) -> edits.Edited:
    people = star_shop(s, d).mechanics
    protected = people.filter(F.col("qualification") == "NATION_0")
    return edits.guarded_delete(people, requests.deleted_mechanics(s, d), protected, "mechanic_id")


def _registered(s: SparkSession, d: str, shop: Shop | None = None) -> cars.Registered:
    shop = shop or star_shop(s, d)
    return cars.register_cars(requests.car_requests(s, d), shop.clients, shop.cars)


def _upserted(s: SparkSession, d: str, strict: bool = False, shop: Shop | None = None) -> cars.Upserted:
    shop = shop or star_shop(s, d)
    return cars.insert_through_view(requests.view_inserts(s, d), shop.clients, shop.cars, strict)


def _duplicate_plates(s: SparkSession, d: str) -> DataFrame:
    judged = cars.judge_plates(requests.car_requests(s, d), star_shop(s, d).cars)
    return judged.filter(F.col("reason").isNotNull()).select("request_id", "license_plate", "reason")


def _prefix(s: SparkSession, d: str) -> stock.Sold:
    return stock.sell_by_prefix(
        star_shop(s, d).parts, requests.sale_lines(s, d), requests.SALE_ARRIVAL
    )


def _one_by_one(s: SparkSession, d: str) -> stock.Sold:
    return stock.sell_one_by_one(
        star_shop(s, d).parts, requests.sale_lines(s, d), requests.SALE_ARRIVAL
    )


def _streamed_parts(s: SparkSession, d: str) -> DataFrame:
    """The sales arrive in ranges of orders, one after another; each is a batch, written and read by many tasks."""
    root = new_shared_folder(s)
    lines = requests.sale_lines(s, d)
    top = (lines.agg(F.max("order_id")).first()[0] or 0) + 1
    ledger = f"{root}/ledger"
    for i in range(STREAM_BATCHES):
        low, high = top * i // STREAM_BATCHES, top * (i + 1) // STREAM_BATCHES
        lines.filter((F.col("order_id") >= low) & (F.col("order_id") < high)).write.parquet(f"{root}/in/part={i}")
        # What has arrived so far is a batch; the next run goes on from the ledger.
        source = s.readStream.schema(lines.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        running = stock_stream.sell_stream(
            source, lambda spark: star_shop(spark, d).parts, requests.SALE_ARRIVAL, ledger, f"{root}/progress"
        )
        running.awaitTermination()
    done = stock_stream.finished_batches(s, ledger)
    return stock_stream.stock_left(s, star_shop(s, d).parts, ledger, done)


def _whole_orders(s: SparkSession, d: str) -> stock.Sold:
    shop = star_shop(s, d)
    return stock.sell_whole_orders(shop.parts, shop.parts_in_orders)


def _returned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shop = star_shop(s, d)
    return stock.return_lines(shop.parts, shop.parts_in_orders, requests.returned_pairs(s, d))


def _merged_parts(s: SparkSession, d: str, picks: DataFrame | None = None) -> DataFrame:
    """The parts after the deliveries: some of them nobody has ordered yet."""
    return edits.merge_stock(star_shop(s, d).parts, requests.deliveries(s, d, picks))


def _deleted_parts(s: SparkSession, d: str, picks: DataFrame | None = None) -> stock.Deletion:
    merged = _merged_parts(s, d, picks)
    return stock.delete_parts(merged, merged, star_shop(s, d).parts_in_orders)


def _check_option(s: SparkSession, d: str, cascaded: bool) -> checks.Checked:
    """Every part is written back 200 dearer through a view of cheap parts over a view of stocked parts."""
    rows = star_shop(s, d).parts.withColumn("price", (F.col("price") + 200).cast("decimal(10,2)"))
    return checks.check_option(rows, F.col("price") <= 1100, [F.col("stock_quantity") >= 800], cascaded)


def _registered_ids(s: SparkSession, d: str, shop: Shop | None = None) -> cars.Registered:
    shop = shop or star_shop(s, d)
    return cars.register_cars(requests.car_requests_with_ids(s, d), shop.clients, shop.cars)


def _saved_cars(s: SparkSession, d: str, clash: bool) -> saving.Saved:
    return saving.save_cars(star_shop(s, d).cars, requests.car_edits(s, d, clash))


def _saved_mechanics(s: SparkSession, d: str) -> saving.SavedMechanics:
    shop = star_shop(s, d)
    return saving.save_mechanics(shop.mechanics, requests.mechanic_edits(s, d), shop.services_in_orders, SEED)


def _saved_parts(s: SparkSession, d: str, clash: bool) -> saving.Saved:
    shop = star_shop(s, d)
    return saving.save_parts(shop.parts, requests.part_edits(s, d, clash), shop.parts_in_orders)


def _refusals(s: SparkSession, d: str) -> dict[str, Callable[[], DataFrame]]:
    """What each source refuses, with a reason per row; planned when asked for.

    What many sources read, the picks, the cars, the few services and the first judgement on part lists, is written once. Sources that take many short rounds come first.
    """
    plain = star_shop(s, d)
    shop = star_shop(s, d, cars=stage(plain.cars), services=stage(plain.services))
    picks = stage(requests.order_picks(s, d))
    names = requests.name_requests(s, d, picks)
    ids = requests.id_requests(s, d, picks)
    lists = requests.part_order_requests(s, d, picks)
    judged = stage(orders.judge_parts(lists, shop.parts))

    def not_ok(answers: DataFrame) -> DataFrame:
        return answers.filter(F.col("status") != K.OK).withColumnRenamed("status", "reason")

    def unknown(found: DataFrame, key: str, reason: str) -> DataFrame:
        return found.filter(F.col(key).isNull()).withColumn("reason", F.lit(reason))

    return {
        "whole_orders": lambda: _whole_orders(s, d).rejects,
        "add_parts_in_sequence": lambda: orders.add_parts_in_sequence(lists, shop.parts, judged=judged).rejects,
        "register_cars_with_ids": lambda: _registered_ids(s, d, shop).rejects,
        "view_inserts": lambda: _upserted(s, d, shop=shop).rejects,
        "place_orders": lambda: pricing.placed(s, d, shop, picks).rejects,
        "single_sales": lambda: _one_by_one(s, d).rejects,
        "register_cars": lambda: _registered(s, d, shop).rejects,
        "add_parts": lambda: orders.add_parts_to_orders(lists, shop.parts, judged).rejects,
        "add_services": lambda: pricing.added_services(s, d, shop, picks).rejects,
        "append_clients": lambda: _appended(s, d).rejects,
        "check_option": lambda: _check_option(s, d, True).rejects,
        "delete_mechanics": lambda: _guarded(s, d).rejects,
        "delete_parts": lambda: _deleted_parts(s, d, picks).blocked,
        "edit_clients": lambda: _edited(s, d).rejects,
        "lookup_parts": lambda: unknown(
            lookups.lookup_part_ids(requests.part_refs(s, d, picks), shop.parts), "part_id", K.PART_NOT_FOUND
        ),
        "lookup_services": lambda: unknown(
            lookups.lookup_service_ids(requests.service_refs(s, d, picks), shop.services), "service_id", K.SERVICE_NOT_FOUND
        ),
        "part_lists": lambda: lookups.resolve_part_list(names, shop.parts).rejects,
        "phones": lambda: not_ok(_phones(s, d).statuses),
        "price_parts": lambda: not_ok(prices.parts_price_by_ids(ids, shop.parts)),
        "price_services": lambda: not_ok(prices.services_price_by_ids(ids, shop.services)),
        "quote_by_ids": lambda: not_ok(prices.quote_by_ids(ids, shop.parts, shop.services)),
        "quote_by_names": lambda: not_ok(prices.quote_by_names(names, shop.parts, shop.services)),
        "quote_with_quantity": lambda: not_ok(prices.quote_with_quantity(ids, shop.parts, shop.services)),
        "sales": lambda: _prefix(s, d).rejects,
        "service_lists": lambda: lookups.resolve_service_list(names, shop.services).rejects,
    }


def _rejects_report(s: SparkSession, d: str) -> DataFrame:
    ledger = rejects.write_ledger(s, _refusals(s, d))
    return rejects.count_reasons(ledger)


APPEND_STEPS = """
asked AS (
  SELECT request_id, CASE WHEN role = 'mechanic' THEN '' ELSE 'New ' || cast(request_id AS varchar) END AS full_name,
         regexp_replace(typed_phone, '[-() ]', '', 'g') AS phone,
         CASE WHEN length(typed_phone) <> 18 THEN 'bad_phone' WHEN role = 'mechanic' THEN 'missing_field' END AS reason
  FROM typed)"""

PHONE_STEPS = r"""
phone_asked AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey + 1000000000 ELSE c_custkey END AS client_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN concat('+7', lpad(cast(c_custkey AS varchar(20)), 10, '5'))
           WHEN 'BUILDING' THEN '+799912368'
           WHEN 'FURNITURE' THEN concat('+7', lpad(cast(c_custkey AS varchar(20)), 10, '0'))
           ELSE concat('+78', lpad(cast(c_custkey // 2 AS varchar(20)), 9, '0')) END AS new_phone
  FROM customer),
phone_statuses AS (
  SELECT request_id, client_id, new_phone,
         CASE WHEN NOT regexp_full_match(new_phone, '\+7[0-9]{10}') THEN 'bad_phone'
              WHEN new_phone IN (SELECT phone FROM sv_clients) THEN 'phone_taken'
              WHEN EXISTS (SELECT 1 FROM phone_asked b WHERE b.new_phone = a.new_phone AND b.request_id < a.request_id
                           AND b.client_id IN (SELECT client_id FROM sv_clients)) THEN 'phone_taken'
              ELSE 'ok' END AS status
  FROM phone_asked a)"""

EDIT_STEPS = """
edits AS (
  SELECT o_orderkey AS seq,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'update' WHEN '2' THEN 'delete' WHEN '3' THEN 'insert'
           WHEN '4' THEN 'update' ELSE 'insert' END AS op,
         CASE WHEN substring(o_orderpriority, 1, 1) IN ('3', '4') THEN o_custkey + 1000000000
              ELSE o_custkey END AS client_id,
         'Edit ' || cast(o_orderkey AS varchar) AS full_name,
         concat('+7', lpad(cast(o_orderkey AS varchar(20)), 10, '6')) AS phone
  FROM orders),
edits_met AS (
  SELECT e.*, coalesce(last_value(CASE WHEN op <> 'update' THEN op = 'insert' END IGNORE NULLS) OVER (
           PARTITION BY e.client_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           c.client_id IS NOT NULL) AS there
  FROM edits e LEFT JOIN sv_clients c ON c.client_id = e.client_id),
edit_conflicts AS (SELECT seq, client_id FROM edits_met WHERE (op = 'insert') = there),
net AS (
  SELECT client_id, arg_max(op, seq) FILTER (op <> 'update') AS last_turn,
         arg_max(full_name, seq) FILTER (op <> 'delete' AND (op = 'insert') <> there) AS full_name,
         arg_max(phone, seq) FILTER (op <> 'delete' AND (op = 'insert') <> there) AS phone
  FROM edits_met GROUP BY client_id)"""

CAR_STEPS = """
car_asked AS (
  SELECT c_custkey AS request_id, c_name AS model, c_mktsegment AS color,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_custkey END AS owner_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'N' || cast(c_custkey AS varchar)
           WHEN 'BUILDING' THEN 'P' || cast(c_custkey AS varchar) || '1'
           WHEN 'FURNITURE' THEN 'D' || lpad(cast(c_custkey // 2 AS varchar(20)), 9, '0')
           WHEN 'HOUSEHOLD' THEN 'D' || lpad(cast(c_custkey // 2 AS varchar(20)), 9, '0') END AS license_plate
  FROM customer),
car_judged AS (
  SELECT *, CASE WHEN owner_id IS NULL THEN 'client_not_found'
                 WHEN license_plate IN (SELECT license_plate FROM sv_cars) THEN 'duplicate_plate'
                 WHEN row_number() OVER (PARTITION BY owner_id IS NULL, license_plate ORDER BY request_id) > 1
                      AND license_plate IS NOT NULL THEN 'duplicate_plate' ELSE 'ok' END AS status
  FROM car_asked)"""

VIEW_STEPS = """
inserted AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN d IN ('2', '5') THEN o_custkey + 1000000000 ELSE o_custkey END AS client_id,
         'Owner ' || cast(o_orderkey AS varchar) AS full_name,
         concat('+7', lpad(cast(o_orderkey AS varchar(20)), 10, '4')) AS phone,
         CASE d WHEN '1' THEN o_custkey * 10 + 1 WHEN '2' THEN o_orderkey + 1000000000000
           WHEN '3' THEN o_orderkey + 2000000000000 WHEN '4' THEN o_custkey + 3000000000000
           ELSE o_orderkey + 4000000000000 END AS car_id,
         o_orderpriority AS model, 'white' AS color,
         CASE d WHEN '2' THEN 'V' || cast(o_orderkey AS varchar) WHEN '4' THEN 'W' || cast(o_custkey AS varchar)
           WHEN '5' THEN 'Z' || cast(o_custkey AS varchar)
           ELSE 'P' || cast(o_custkey * 10 + 1 AS varchar) END AS license_plate
  FROM (SELECT *, substring(o_orderpriority, 1, 1) AS d FROM orders)),
kept AS (
  SELECT * FROM inserted i
  WHERE car_id IN (SELECT car_id FROM sv_cars)
     OR (license_plate NOT IN (SELECT license_plate FROM sv_cars)
         AND car_id = (SELECT arg_min(f.car_id, f.request_id) FROM inserted f
                       WHERE f.license_plate = i.license_plate)))"""

SALES_STEPS = """
sales AS (
  SELECT l_orderkey AS order_id, cast(l_linenumber AS bigint) AS line_no, l_partkey AS part_id,
         l_suppkey AS mechanic_id, cast(l_quantity AS bigint) AS quantity,
         cast(l_extendedprice AS decimal(12,2)) AS amount, cast(l_shipdate AS date) AS ship_date
  FROM lineitem WHERE l_linestatus = 'F'),
running AS (
  SELECT s.*, p.stock_quantity, cast(sum(quantity) OVER (
           PARTITION BY s.part_id ORDER BY order_id, line_no, mechanic_id, quantity, amount, ship_date
           ROWS UNBOUNDED PRECEDING) AS bigint) AS running
  FROM sales s JOIN sv_parts p ON p.part_id = s.part_id)"""

GREEDY_STEPS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY part_id
           ORDER BY order_id, line_no, mechanic_id, quantity, amount, ship_date) AS nth FROM sales),
greedy AS (
  SELECT part_id, cast(0 AS bigint) AS nth, cast(stock_quantity AS bigint) AS stock_left, true AS sold FROM sv_parts
  UNION ALL
  SELECT g.part_id, n.nth, CASE WHEN n.quantity <= g.stock_left THEN g.stock_left - n.quantity ELSE g.stock_left END,
         n.quantity <= g.stock_left
  FROM greedy g JOIN numbered n ON n.part_id = g.part_id AND n.nth = g.nth + 1)"""

USED_SQL = "SELECT part_id FROM sv_parts_in_orders"
MERGE_STEPS = (
    pricing.PICKS_SQL
    + """,
arrivals AS (
  SELECT CASE WHEN d = 2 THEN c + 1000000000 ELSE c END AS part_id, sum(mo) AS arrived,
         arg_max(n, request_id) AS part_name, arg_max(m, request_id) AS manufacturer,
         arg_max(mo * 10, request_id) AS price
  FROM picks GROUP BY 1),
merged AS (
  SELECT coalesce(p.part_id, a.part_id) AS part_id, coalesce(p.part_name, a.part_name) AS part_name,
         coalesce(p.manufacturer, a.manufacturer) AS manufacturer, coalesce(a.price, p.price) AS price,
         coalesce(p.stock_quantity, 0) + coalesce(a.arrived, 0) AS stock_quantity
  FROM sv_parts p FULL JOIN arrivals a ON a.part_id = p.part_id)"""
)
RETURNED_SQL = "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'"
GONE_SQL = """SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0"""
PART_HEAD = "part_id, part_name, manufacturer, cast(price AS double) AS price"
OPTION_HEAD = (
    "part_id, part_name, manufacturer, cast(price + 200 AS double) AS price, "
    "cast(stock_quantity AS bigint) AS stock_quantity"
)
MECHANIC_HEAD = "mechanic_id, full_name, phone_number, qualification"

# Requests with ids: those that neither a stored plate nor a stored id refuses, one after another.
GIVEN_STEPS = """
given AS (
  SELECT a.*, CASE WHEN request_id % 4 = 1 THEN request_id * 10 + 1
                   WHEN request_id % 4 >= 2 THEN request_id // 2 + 5000000000 END AS car_id
  FROM car_asked a),
given_stored AS (
  SELECT *, CASE WHEN owner_id IS NULL THEN 'client_not_found'
                 WHEN license_plate IN (SELECT license_plate FROM sv_cars) THEN 'duplicate_plate'
                 WHEN car_id IN (SELECT car_id FROM sv_cars) THEN 'duplicate_key' END AS stored_reason
  FROM given),
given_turns AS (
  SELECT *, row_number() OVER (ORDER BY request_id) AS k FROM given_stored WHERE stored_reason IS NULL),
given_fold AS (
  SELECT cast(0 AS bigint) AS k, cast(NULL AS bigint) AS request_id, cast(NULL AS varchar) AS reason,
         cast([] AS varchar[]) AS plates, cast([] AS bigint[]) AS ids
  UNION ALL
  SELECT k, request_id, reason, CASE WHEN reason IS NULL THEN list_append(plates, license_plate) ELSE plates END,
         CASE WHEN reason IS NULL THEN list_append(ids, car_id) ELSE ids END
  FROM (SELECT t.k, t.request_id, t.license_plate, t.car_id, f.plates, f.ids,
               CASE WHEN list_contains(f.plates, t.license_plate) THEN 'duplicate_plate'
                    WHEN list_contains(f.ids, t.car_id) THEN 'duplicate_key' END AS reason
        FROM given_fold f JOIN given_turns t ON t.k = f.k + 1)),
given_judged AS (
  SELECT g.*, coalesce(stored_reason, f.reason) AS reason FROM given_stored g LEFT JOIN given_fold f USING (request_id)),
given_cars AS (
  SELECT coalesce(car_id, (SELECT greatest((SELECT max(car_id) FROM sv_cars), max(car_id)) FROM given_judged WHERE reason IS NULL)
                          + row_number() OVER (PARTITION BY car_id IS NULL ORDER BY request_id)) AS car_id,
         owner_id, model, color, license_plate
  FROM given_judged WHERE reason IS NULL)"""

EXPERIENCE_STEPS = """
updates AS (
  SELECT l_suppkey AS mechanic_id, l_orderkey * 10 + l_linenumber AS seq,
         CASE WHEN l_returnflag <> 'R' THEN cast(floor(l_quantity / 10) AS int) END AS experience
  FROM lineitem),
steps AS (
  SELECT u.mechanic_id, u.experience, row_number() OVER w AS nth,
         CASE WHEN row_number() OVER w = 1 THEN m.experience ELSE lag(u.experience) OVER w END AS old
  FROM updates u JOIN sv_mechanics m ON m.mechanic_id = u.mechanic_id
  WINDOW w AS (PARTITION BY u.mechanic_id ORDER BY u.seq, u.experience NULLS FIRST)),
raised AS (
  SELECT mechanic_id, count(*) FILTER (experience IS DISTINCT FROM old) AS times, max(nth) AS nth
  FROM steps GROUP BY mechanic_id)"""

REPORT_STEPS = ",".join(
    [
        pricing.PLACED_SQL,
        pricing.PART_REQUEST_STEPS,
        fold_steps(
            """SELECT request_id AS turn, part_id, quantity FROM reasons
               WHERE request_id NOT IN (SELECT request_id FROM refused)""",
            "asked_",
        ),
        fold_steps("SELECT order_id AS turn, part_id, quantity FROM sv_parts_in_orders", "stored_"),
        pricing.SERVICE_REQUEST_STEPS,
        TYPED_SQL,
        APPEND_STEPS,
        PHONE_STEPS,
        EDIT_STEPS,
        CAR_STEPS,
        GIVEN_STEPS,
        VIEW_STEPS,
        SALES_STEPS,
        GREEDY_STEPS,
        f"""
refusals AS (
  SELECT 'add_parts' AS source, reason FROM refused
  UNION ALL SELECT 'add_parts', 'null_list' FROM picks WHERE d = 5
  UNION ALL SELECT 'add_services', 'service_not_found'
            FROM (SELECT DISTINCT request_id FROM service_matched WHERE service_id IS NULL)
  UNION ALL SELECT 'add_services', 'null_list' FROM picks WHERE d = 5
  UNION ALL SELECT 'append_clients', reason FROM asked WHERE reason IS NOT NULL
  UNION ALL SELECT 'check_option', 'check_failed' FROM sv_parts WHERE NOT (price <= 900 AND stock_quantity >= 800)
  UNION ALL SELECT 'delete_mechanics', 'self_delete' FROM sv_mechanics
            WHERE mechanic_id IN ({GONE_SQL}) AND qualification = 'NATION_0'
  UNION ALL SELECT 'delete_parts', 'part_in_use' FROM sv_parts WHERE part_id IN ({USED_SQL})
  UNION ALL SELECT 'edit_clients', 'edit_conflict' FROM edit_conflicts
  UNION ALL SELECT 'part_lists', 'part_not_found' FROM picks WHERE d IN (2, 4)
  UNION ALL SELECT 'part_lists', 'null_list' FROM picks WHERE d = 5
  UNION ALL SELECT 'phones', status FROM phone_statuses WHERE status <> 'ok'
  UNION ALL SELECT 'place_orders', status FROM judged WHERE status <> 'ok'
  UNION ALL SELECT 'place_orders', 'insufficient_stock' FROM short_requests
  UNION ALL SELECT 'add_parts_in_sequence', reason FROM refused
  UNION ALL SELECT 'add_parts_in_sequence', 'null_list' FROM picks WHERE d = 5
  UNION ALL SELECT 'add_parts_in_sequence', 'insufficient_stock' FROM asked_taking WHERE turn IS NOT NULL AND NOT granted
  UNION ALL SELECT 'whole_orders', 'insufficient_stock' FROM stored_taking WHERE turn IS NOT NULL AND NOT granted
  UNION ALL SELECT 'single_sales', 'insufficient_stock' FROM greedy WHERE nth > 0 AND NOT sold
  UNION ALL SELECT 'lookup_parts', 'part_not_found' FROM picks WHERE d = 2
  UNION ALL SELECT 'lookup_services', 'service_not_found' FROM picks WHERE d = 5
  UNION ALL SELECT 'view_inserts', 'duplicate_plate' FROM inserted WHERE request_id NOT IN (SELECT request_id FROM kept)
  UNION ALL SELECT 'register_cars_with_ids', reason FROM given_judged WHERE reason IS NOT NULL
  UNION ALL SELECT 'price_parts', CASE WHEN d = 4 THEN 'null_list' ELSE 'part_not_found' END FROM priced
            WHERE d = 4 OR part_misses > 0
  UNION ALL SELECT 'price_services', 'service_not_found' FROM priced WHERE service_misses > 0
  UNION ALL SELECT 'quote_by_ids', {pricing.STATUS} FROM priced WHERE {pricing.STATUS} <> 'ok'
  UNION ALL SELECT 'quote_with_quantity', {pricing.STATUS} FROM priced WHERE {pricing.STATUS} <> 'ok'
  UNION ALL SELECT 'quote_by_names', 'null_list' FROM picks WHERE d = 5
  UNION ALL SELECT 'register_cars', status FROM car_judged WHERE status <> 'ok'
  UNION ALL SELECT 'sales', 'insufficient_stock' FROM running WHERE running > stock_quantity
  UNION ALL SELECT 'service_lists', 'service_not_found' FROM picks WHERE d IN (2, 5))""",
    ]
)

QUERIES: list[Query] = [
    query(
        "append_clients",
        lambda s, d: _appended(s, d).table,
        sql(
            """SELECT client_id, full_name, phone FROM sv_clients
               UNION ALL
               SELECT (SELECT max(client_id) FROM sv_clients) + row_number() OVER (ORDER BY request_id), full_name, phone
               FROM asked WHERE reason IS NULL""",
            TYPED_SQL + "," + APPEND_STEPS,
        ),
    ),
    query(
        "apply_edits",
        lambda s, d: _edited(s, d).table,
        sql(
            """SELECT coalesce(c.client_id, n.client_id) AS client_id, coalesce(n.full_name, c.full_name) AS full_name,
                      coalesce(n.phone, c.phone) AS phone
               FROM sv_clients c FULL JOIN net n ON n.client_id = c.client_id
               WHERE coalesce(n.last_turn = 'insert', c.client_id IS NOT NULL)""",
            EDIT_STEPS,
        ),
    ),
    query(
        "apply_edits_rejects",
        lambda s, d: _edited(s, d).rejects,
        sql("SELECT seq, client_id, 'edit_conflict' AS reason FROM edit_conflicts", EDIT_STEPS),
    ),
    query(
        "guarded_delete",
        lambda s, d: _guarded(s, d).table,
        sql(
            f"""SELECT {MECHANIC_HEAD}, cast(salary AS double) AS salary, cast(experience AS bigint) AS experience
                FROM sv_mechanics WHERE mechanic_id NOT IN ({GONE_SQL}) OR qualification = 'NATION_0'"""
        ),
    ),
    query(
        "update_phones",
        lambda s, d: _phones(s, d).table,
        sql(
            """SELECT c.client_id, c.full_name, coalesce(s.new_phone, c.phone) AS phone
               FROM sv_clients c LEFT JOIN phone_statuses s ON s.client_id = c.client_id AND s.status = 'ok'""",
            PHONE_STEPS,
        ),
    ),
    query(
        "update_phones_statuses",
        lambda s, d: _phones(s, d).statuses,
        sql("SELECT request_id, client_id, new_phone, status FROM phone_statuses", PHONE_STEPS),
    ),
    query(
        "register_cars",
        lambda s, d: _registered(s, d).cars,
        sql(
            """SELECT car_id, owner_id, model, color, license_plate FROM sv_cars
               UNION ALL
               SELECT (SELECT max(car_id) FROM sv_cars) + row_number() OVER (ORDER BY request_id), owner_id, model, color,
                      license_plate FROM car_judged WHERE status = 'ok'""",
            CAR_STEPS,
        ),
    ),
    query(
        "register_cars_listing",
        lambda s, d: cars.client_cars(_registered(s, d), star_shop(s, d).clients),
        sql(
            """SELECT a.owner_id AS client_id, c.phone, a.car_id, a.model, a.color, a.license_plate
               FROM (SELECT car_id, owner_id, model, color, license_plate FROM sv_cars
                     UNION ALL
                     SELECT (SELECT max(car_id) FROM sv_cars) + row_number() OVER (ORDER BY request_id), owner_id, model,
                            color, license_plate FROM car_judged WHERE status = 'ok') a
               JOIN sv_clients c ON c.client_id = a.owner_id
               WHERE a.owner_id IN (SELECT owner_id FROM car_judged WHERE status = 'ok')""",
            CAR_STEPS,
        ),
    ),
    query(
        "register_cars_given_ids",
        lambda s, d: _registered_ids(s, d).cars,
        recursive(
            """SELECT car_id, owner_id, model, color, license_plate FROM sv_cars
               UNION ALL SELECT car_id, owner_id, model, color, license_plate FROM given_cars""",
            CAR_STEPS + "," + GIVEN_STEPS,
        ),
    ),
    query(
        "register_cars_given_ids_rejects",
        lambda s, d: _registered_ids(s, d).rejects,
        recursive(
            "SELECT request_id, reason FROM given_judged WHERE reason IS NOT NULL", CAR_STEPS + "," + GIVEN_STEPS
        ),
    ),
    query(
        "edit_cars_with_rules",
        lambda s, d: _saved_cars(s, d, False).table,
        sql(
            """SELECT CASE WHEN car_id % 10 = 1 THEN car_id + 1000000000 ELSE car_id END AS car_id, owner_id,
                      CASE car_id % 10 WHEN 1 THEN 'Reborn' WHEN 3 THEN 'Back' ELSE model END AS model,
                      CASE WHEN car_id % 10 = 2 THEN 'red' ELSE color END AS color,
                      CASE WHEN car_id % 10 = 2 THEN 'E' || cast(car_id AS varchar) ELSE license_plate END AS license_plate
               FROM sv_cars"""
        ),
    ),
    query(
        "edit_cars_refused",
        lambda s, d: _saved_cars(s, d, True).refused,
        sql(
            """SELECT car_id * 4 AS seq, car_id + 3000000000 AS car_id, 'duplicate_plate' AS reason
               FROM sv_cars WHERE car_id % 10 = 5 ORDER BY car_id LIMIT 1"""
        ),
    ),
    query(
        "edit_mechanics_with_rules",
        lambda s, d: _saved_mechanics(s, d).table,
        sql(
            f"""SELECT {MECHANIC_HEAD},
                       cast(CASE mechanic_id % 5 WHEN 1 THEN 5000 WHEN 2 THEN salary + 10000 * (experience IS NOT NULL)::int
                            WHEN 3 THEN 10100 ELSE salary END AS double) AS salary,
                       cast(CASE mechanic_id % 5 WHEN 1 THEN experience + 1 WHEN 2 THEN NULL WHEN 3 THEN 2
                            ELSE experience END AS bigint) AS experience
                FROM sv_mechanics WHERE mechanic_id % 5 <> 0
                UNION ALL
                SELECT mechanic_id + 1000000000, full_name, phone_number, qualification, cast(salary AS double), 3
                FROM sv_mechanics WHERE mechanic_id % 5 = 4"""
        ),
    ),
    query(
        "edit_mechanics_service_lines",
        lambda s, d: _saved_mechanics(s, d).service_lines,
        sql(
            f"""SELECT order_id, service_id,
                       CASE WHEN mechanic_id % 5 IN (0, 3) THEN (
                         SELECT arg_min(id, md5('{SEED}:' || cast(id AS varchar)))
                         FROM (SELECT mechanic_id AS id FROM sv_mechanics WHERE mechanic_id % 5 IN (1, 2, 4)
                               UNION ALL SELECT mechanic_id + 1000000000 FROM sv_mechanics WHERE mechanic_id % 5 = 4))
                       ELSE mechanic_id END AS mechanic_id, cast(quantity AS bigint) AS quantity
                FROM sv_services_in_orders"""
        ),
    ),
    query(
        "edit_parts_with_rules",
        lambda s, d: _saved_parts(s, d, False).table,
        sql(
            """SELECT part_id, part_name, manufacturer,
                      cast(CASE WHEN part_id % 3 = 1 THEN price + 1 ELSE price END AS double) AS price,
                      cast(stock_quantity AS bigint) AS stock_quantity
               FROM sv_parts"""
        ),
    ),
    query(
        "edit_parts_refused",
        lambda s, d: _saved_parts(s, d, True).refused,
        sql(
            f"""SELECT part_id * 4 AS seq, part_id, 'part_in_use' AS reason FROM sv_parts
                WHERE part_id % 3 = 2 AND part_id % 7 = 3 AND part_id IN ({USED_SQL}) ORDER BY part_id LIMIT 1"""
        ),
    ),
    query(
        "salary_after_repeated_updates",
        lambda s, d: mechanics.raise_for_experience(star_shop(s, d).mechanics, requests.experience_sequences(s, d)),
        sql(
            """SELECT m.mechanic_id, m.full_name, m.phone_number, m.qualification,
                      cast(m.salary + 10000 * coalesce(r.times, 0) AS double) AS salary,
                      cast(CASE WHEN r.mechanic_id IS NULL THEN m.experience ELSE s.experience END AS bigint) AS experience
               FROM sv_mechanics m LEFT JOIN raised r ON r.mechanic_id = m.mechanic_id
               LEFT JOIN steps s ON s.mechanic_id = r.mechanic_id AND s.nth = r.nth""",
            EXPERIENCE_STEPS,
        ),
    ),
    query(
        "duplicate_plates",
        _duplicate_plates,
        sql(
            """SELECT request_id, license_plate, 'duplicate_plate' AS reason FROM car_asked a
               WHERE license_plate IN (SELECT license_plate FROM sv_cars)
                  OR EXISTS (SELECT 1 FROM car_asked b
                             WHERE b.license_plate = a.license_plate AND b.request_id < a.request_id)""",
            CAR_STEPS,
        ),
    ),
    query(
        "upsert_clients_from_view",
        lambda s, d: _upserted(s, d).clients,
        sql(
            """SELECT client_id, full_name, phone FROM sv_clients
               UNION ALL
               SELECT client_id, arg_min(full_name, request_id), arg_min(phone, request_id) FROM kept
               WHERE client_id NOT IN (SELECT client_id FROM sv_clients) GROUP BY client_id""",
            VIEW_STEPS,
        ),
    ),
    query(
        "upsert_cars_from_view",
        lambda s, d: _upserted(s, d).cars,
        sql(
            """SELECT car_id, owner_id, model, color, license_plate FROM sv_cars
               UNION ALL
               SELECT car_id, arg_min(client_id, request_id), arg_min(model, request_id), arg_min(color, request_id),
                      arg_min(license_plate, request_id)
               FROM kept WHERE car_id NOT IN (SELECT car_id FROM sv_cars) GROUP BY car_id""",
            VIEW_STEPS,
        ),
    ),
    query(
        "salary_after_experience",
        lambda s, d: mechanics.raise_for_experience(star_shop(s, d).mechanics, requests.experience_updates(s, d)),
        sql(
            f"""SELECT {MECHANIC_HEAD}, cast(CASE WHEN updated AND changed IS DISTINCT FROM experience
                                             THEN salary + 10000 ELSE salary END AS double) AS salary,
                       cast(CASE WHEN updated THEN changed ELSE experience END AS bigint) AS experience
                FROM (SELECT m.*, s_nationkey < 23 AS updated,
                             CASE WHEN s_nationkey < 8 THEN experience + 1 WHEN s_nationkey < 14 THEN experience
                                  WHEN s_nationkey < 20 THEN experience - 1 END AS changed
                      FROM sv_mechanics m JOIN supplier ON s_suppkey = mechanic_id)"""
        ),
    ),
    query(
        "update_order_dates",
        lambda s, d: orders.update_order_dates(star_shop(s, d).orders, requests.order_date_changes(s, d)),
        sql(
            """SELECT order_id, client_id, car_id, workplace_id,
                      CASE workplace_id WHEN 0 THEN order_date + 7 WHEN 1 THEN NULL ELSE order_date END AS order_date,
                      payment_type_id, cast(total_amount AS double) AS total_amount
               FROM sv_orders"""
        ),
    ),
    query(
        "reassign_mechanics",
        lambda s, d: mechanics.reassign_mechanics(
            star_shop(s, d).services_in_orders, star_shop(s, d).mechanics, requests.deleted_mechanics(s, d), SEED
        ),
        sql(
            f"""SELECT order_id, service_id,
                       CASE WHEN mechanic_id IN ({GONE_SQL}) THEN (
                         SELECT arg_min(mechanic_id, md5('{SEED}:' || cast(mechanic_id AS varchar))) FROM sv_mechanics
                         WHERE mechanic_id NOT IN ({GONE_SQL})) ELSE mechanic_id END AS mechanic_id,
                       cast(quantity AS bigint) AS quantity
                FROM sv_services_in_orders"""
        ),
    ),
    query(
        "stock_after_sales",
        lambda s, d: _prefix(s, d).parts,
        sql(
            f"""SELECT {PART_HEAD}, cast(stock_quantity - coalesce((
                         SELECT sum(quantity) FROM running r WHERE r.part_id = p.part_id
                         AND r.running <= r.stock_quantity), 0) AS bigint) AS stock_quantity
                FROM sv_parts p""",
            SALES_STEPS,
        ),
    ),
    query(
        "stock_overdraw_lines",
        lambda s, d: _prefix(s, d).rejects,
        sql(
            """SELECT order_id, line_no, part_id, mechanic_id, quantity, cast(amount AS double) AS amount, ship_date,
                      running, cast(stock_quantity AS bigint) AS stock_quantity, 'insufficient_stock' AS reason
               FROM running WHERE running > stock_quantity""",
            SALES_STEPS,
        ),
    ),
    query(
        "stock_after_statement",
        lambda s, d: stock.sell_as_statement(star_shop(s, d).parts, requests.sale_lines(s, d)).parts,
        sql(
            f"""SELECT {PART_HEAD}, cast(CASE WHEN EXISTS (SELECT 1 FROM running WHERE running > stock_quantity)
                         THEN stock_quantity ELSE stock_quantity - coalesce((
                           SELECT sum(quantity) FROM running r WHERE r.part_id = p.part_id), 0) END AS bigint)
                         AS stock_quantity
                FROM sv_parts p""",
            SALES_STEPS,
        ),
    ),
    query(
        "stock_after_single_sales",
        lambda s, d: _one_by_one(s, d).parts,
        sql(
            f"""SELECT {PART_HEAD}, (SELECT arg_max(stock_left, nth) FROM greedy g WHERE g.part_id = p.part_id)
                       AS stock_quantity
                FROM sv_parts p""",
            SALES_STEPS + "," + GREEDY_STEPS,
        ).replace("WITH", "WITH RECURSIVE", 1),
    ),
    query(
        "stream_stock_after_sales",
        _streamed_parts,
        sql(
            f"""SELECT {PART_HEAD}, (SELECT arg_max(stock_left, nth) FROM greedy g WHERE g.part_id = p.part_id)
                       AS stock_quantity
                FROM sv_parts p""",
            SALES_STEPS + "," + GREEDY_STEPS,
        ).replace("WITH", "WITH RECURSIVE", 1),
    ),
    query(
        "stock_after_whole_orders",
        lambda s, d: _whole_orders(s, d).parts,
        sql(
            f"""SELECT {PART_HEAD}, (SELECT arg_max(stock, k) FROM taking)[i] AS stock_quantity
                FROM sv_parts p JOIN stocked s USING (part_id)""",
            fold_steps("SELECT order_id AS turn, part_id, quantity FROM sv_parts_in_orders"),
        ).replace("WITH", "WITH RECURSIVE", 1),
    ),
    query(
        "stock_after_returns",
        lambda s, d: _returned(s, d)[0],
        sql(
            f"""SELECT {PART_HEAD}, cast(stock_quantity + coalesce((
                         SELECT sum(quantity) FROM sv_parts_in_orders l WHERE l.part_id = p.part_id
                         AND (l.order_id, l.part_id) IN ({RETURNED_SQL})), 0) AS bigint) AS stock_quantity
                FROM sv_parts p"""
        ),
    ),
    query(
        "lines_after_returns",
        lambda s, d: _returned(s, d)[1],
        sql(
            f"""SELECT order_id, part_id, cast(quantity AS bigint) AS quantity FROM sv_parts_in_orders
                WHERE (order_id, part_id) NOT IN ({RETURNED_SQL})"""
        ),
    ),
    query(
        "blocked_part_deletes",
        lambda s, d: _deleted_parts(s, d).blocked,
        sql(f"SELECT part_id, 'part_in_use' AS reason FROM merged WHERE part_id IN ({USED_SQL})", MERGE_STEPS),
    ),
    query(
        "parts_after_deletes",
        lambda s, d: _deleted_parts(s, d).parts,
        sql(f"SELECT {PART_COLUMNS} FROM merged WHERE part_id IN ({USED_SQL})", MERGE_STEPS),
    ),
    query(
        "parts_unused",
        lambda s, d: views.parts_unused(_merged_parts(s, d), star_shop(s, d).parts_in_orders),
        sql(f"SELECT {PART_COLUMNS} FROM merged WHERE part_id NOT IN ({USED_SQL})", MERGE_STEPS),
    ),
    query(
        "merge_stock",
        _merged_parts,
        sql(f"SELECT {PART_COLUMNS} FROM merged", MERGE_STEPS),
    ),
    query(
        "check_option_local",
        lambda s, d: _check_option(s, d, False).accepted,
        sql(f"SELECT {OPTION_HEAD} FROM sv_parts WHERE price + 200 <= 1100"),
    ),
    query(
        "check_option_cascaded",
        lambda s, d: _check_option(s, d, True).accepted,
        sql(f"SELECT {OPTION_HEAD} FROM sv_parts WHERE price + 200 <= 1100 AND stock_quantity >= 800"),
    ),
    query(
        "rejects_report",
        _rejects_report,
        recursive("SELECT source, reason, count(*) AS n FROM refusals GROUP BY source, reason", REPORT_STEPS),
    ),
]
