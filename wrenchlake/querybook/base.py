"""What a registered query is, and the SQL that stands for the shop tables in the checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wrenchlake.functions.rules import plain_types

# Last order date of the test tables; reports look back from here.
AS_OF = dt.date(2001, 8, 1)
SINCE = "date '2001-07-02'"
SEED = "shift-1"

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


def query(name: str, run: Runner, sql: str | None) -> Query:
    """Register a runner; its output leaves with plain number types."""
    return Query(name, lambda spark, sf_dir: plain_types(run(spark, sf_dir)), sql)


SHOP_SQL = """
WITH sv_clients AS (
  SELECT c_custkey AS client_id, c_name AS full_name,
         concat('+7', lpad(cast(c_custkey AS varchar(20)), 10, '0')) AS phone
  FROM customer),
sv_mechanics AS (
  SELECT s_suppkey AS mechanic_id, s_name AS full_name,
         concat('+7', lpad(cast(s_suppkey AS varchar(20)), 10, '9')) AS phone_number,
         n_name AS qualification, cast(s_acctbal AS decimal(10,2)) AS salary,
         cast(s_suppkey % 40 AS int) AS experience
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sv_parts AS (
  SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS manufacturer,
         cast(p_retailprice AS decimal(10,2)) AS price, cast(p_size * 40 AS int) AS stock_quantity
  FROM part),
sv_services AS (
  SELECT min(p_partkey) AS service_id, p_type AS service_name,
         min(cast(p_retailprice AS decimal(10,2))) AS price
  FROM part GROUP BY p_type),
sv_cars AS (
  SELECT DISTINCT o_custkey * 10 + cast(substring(o_orderpriority, 1, 1) AS int) AS car_id,
         o_custkey AS owner_id, o_orderpriority AS model, c_mktsegment AS color,
         concat('P', cast(o_custkey * 10 + cast(substring(o_orderpriority, 1, 1) AS int) AS varchar(20))) AS license_plate
  FROM orders JOIN customer ON o_custkey = c_custkey),
sv_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS client_id,
         o_custkey * 10 + cast(substring(o_orderpriority, 1, 1) AS int) AS car_id,
         cast(cast(substring(o_orderpriority, 1, 1) AS int) - 1 AS bigint) AS workplace_id,
         cast(o_orderdate AS date) AS order_date,
         cast(strpos('FOP', o_orderstatus) AS bigint) AS payment_type_id,
         cast(o_totalprice AS decimal(12,2)) AS total_amount
  FROM orders),
sv_parts_in_orders AS (
  SELECT l_orderkey AS order_id, l_partkey AS part_id, cast(l_quantity AS int) AS quantity
  FROM lineitem WHERE l_linestatus = 'F'),
sv_services_in_orders AS (
  SELECT l_orderkey AS order_id, s.service_id, l_suppkey AS mechanic_id, cast(l_quantity AS int) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sv_services s ON p_type = s.service_name
  WHERE l_linestatus = 'O'),
sv_workplaces AS (
  SELECT cast(r_regionkey AS bigint) AS workplace_id, r_name AS workplace_type FROM region),
sv_payment_types AS (
  SELECT DISTINCT cast(strpos('FOP', o_orderstatus) AS bigint) AS payment_type_id, o_orderstatus AS payment_name
  FROM orders)"""

ORDER_COLUMNS = (
    "order_id, client_id, car_id, workplace_id, order_date, payment_type_id, "
    "cast(total_amount AS double) AS total_amount"
)
PART_COLUMNS = (
    "part_id, part_name, manufacturer, cast(price AS double) AS price, cast(stock_quantity AS bigint) AS stock_quantity"
)


def sql(select: str, steps: str = "") -> str:
    """A query over the shop tables; `steps` adds further named steps before the final select."""
    if steps:
        return f"{SHOP_SQL},\n{steps.strip()}\n{select.strip()}"
    return f"{SHOP_SQL}\n{select.strip()}"


def recursive(select: str, steps: str) -> str:
    """As `sql`, with steps that refer to themselves."""
    return sql(select, steps).replace("WITH", "WITH RECURSIVE", 1)


def fold_steps(lines: str, prefix: str = "") -> str:
    """Steps for (turn, part_id, quantity) lines whose turns come one after another, each taking all its parts or none.

    `taking` has a row per turn: its place, whether it was granted, and the stock of all parts after it. The steps' names get the prefix.
    """
    return f"""
{prefix}stocked AS MATERIALIZED (
  SELECT part_id, cast(stock_quantity AS bigint) AS stock, row_number() OVER (ORDER BY part_id) AS i FROM sv_parts),
{prefix}asked_for AS (
  SELECT l.turn, s.i, cast(sum(l.quantity) AS bigint) AS q FROM ({lines}) l JOIN {prefix}stocked s ON s.part_id = l.part_id
  GROUP BY l.turn, s.i),
{prefix}turns AS MATERIALIZED (
  SELECT turn, row_number() OVER (ORDER BY turn) AS k, list(i ORDER BY i) AS places, list(q ORDER BY i) AS quantities
  FROM {prefix}asked_for GROUP BY turn),
{prefix}taking AS (
  SELECT cast(0 AS bigint) AS k, cast(NULL AS bigint) AS turn, false AS granted,
         (SELECT list(stock ORDER BY i) FROM {prefix}stocked) AS stock
  UNION ALL
  SELECT k, turn, granted,
         CASE WHEN granted THEN list_transform(stock, lambda x, i: x - coalesce(quantities[list_position(places, i)], 0))
              ELSE stock END
  FROM (SELECT t.k, t.turn, t.places, t.quantities, s.stock,
               list_aggregate(list_transform(t.places, lambda p, j: s.stock[p] >= t.quantities[j]), 'bool_and') AS granted
        FROM {prefix}taking s JOIN {prefix}turns t ON t.k = s.k + 1))"""
