"""Windows, composed queries, grouping sets and paging."""

from __future__ import annotations

from wrenchlake.operators import positions
from wrenchlake.plans import composed
from wrenchlake.querybook.base import ORDER_COLUMNS, Query, query, sql
from wrenchlake.sources.starmap import star_shop

_BASE = "order_id, client_id, order_date"
_WINDOW = "PARTITION BY client_id ORDER BY order_date, order_id"
_FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
PAYMENTS = ["F", "O", "P"]


def _orders(s, d):
    return star_shop(s, d).orders


def _window(name: str, run, expression: str) -> Query:
    column = name.removeprefix("win_")
    return query(name, run, sql(f"SELECT {_BASE}, {expression} AS {column} FROM sv_orders"))


_TOTAL = "cast(total_amount AS double)"

_SALES_STEPS = """
sold AS (
  SELECT p.manufacturer, p.part_name, cast(sum(l.quantity) AS bigint) AS quantity, sum(l.quantity * p.price) AS amount
  FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id GROUP BY p.manufacturer, p.part_name)"""


def _grouping(grouping: str) -> str:
    return sql(
        f"""SELECT manufacturer, part_name, cast(grouping(manufacturer) AS bigint) AS all_makers,
                   cast(grouping(part_name) AS bigint) AS all_parts, cast(sum(quantity) AS bigint) AS quantity,
                   cast(sum(amount) AS double) AS revenue
            FROM sold GROUP BY {grouping}""",
        _SALES_STEPS,
    )


QUERIES: list[Query] = [
    _window("win_row_number", lambda s, d: positions.with_row_number(_orders(s, d)), f"row_number() OVER ({_WINDOW})"),
    _window(
        "win_rank",
        lambda s, d: positions.with_rank(_orders(s, d)),
        "rank() OVER (PARTITION BY client_id ORDER BY order_date)",
    ),
    _window(
        "win_dense_rank",
        lambda s, d: positions.with_dense_rank(_orders(s, d)),
        "dense_rank() OVER (PARTITION BY client_id ORDER BY order_date)",
    ),
    _window(
        "win_cume_dist",
        lambda s, d: positions.with_cume_dist(_orders(s, d)),
        "cume_dist() OVER (PARTITION BY client_id ORDER BY order_date)",
    ),
    _window("win_ntile", lambda s, d: positions.with_ntile(_orders(s, d), 4), f"ntile(4) OVER ({_WINDOW})"),
    _window(
        "win_lag",
        lambda s, d: positions.with_lag(_orders(s, d), "total_amount", 1, "lag"),
        f"cast(lag(total_amount) OVER ({_WINDOW}) AS double)",
    ),
    _window(
        "win_lead",
        lambda s, d: positions.with_lead(_orders(s, d), "order_date", 2, "lead"),
        f"lead(order_date, 2) OVER ({_WINDOW})",
    ),
    _window(
        "win_first_value",
        lambda s, d: positions.with_first_value(_orders(s, d), "total_amount", "first_value"),
        f"cast(first_value(total_amount) OVER ({_WINDOW} {_FULL}) AS double)",
    ),
    _window(
        "win_last_value",
        lambda s, d: positions.with_last_value(_orders(s, d), "total_amount", "last_value"),
        f"cast(last_value(total_amount) OVER ({_WINDOW} {_FULL}) AS double)",
    ),
    _window(
        "win_nth_value",
        lambda s, d: positions.with_nth_value(_orders(s, d), "total_amount", 2, "nth_value"),
        f"cast(nth_value(total_amount, 2) OVER ({_WINDOW}) AS double)",
    ),
    query(
        "win_partition_sum",
        lambda s, d: positions.with_client_share(_orders(s, d)),
        sql(
            f"""SELECT {_BASE}, cast(sum(total_amount) OVER (PARTITION BY client_id) AS double) AS client_total,
                       {_TOTAL} / cast(sum(total_amount) OVER (PARTITION BY client_id) AS double) AS share
                FROM sv_orders"""
        ),
    ),
    query(
        "subq_above_avg",
        lambda s, d: composed.orders_above_average(star_shop(s, d)),
        sql(
            f"""SELECT order_id, client_id, {_TOTAL} AS total_amount FROM sv_orders
                WHERE {_TOTAL} > (SELECT cast(sum(total_amount) AS double) / count(total_amount) FROM sv_orders)"""
        ),
    ),
    query(
        "subq_select_last_order",
        lambda s, d: composed.clients_with_last_order(star_shop(s, d)),
        sql(
            """SELECT client_id, full_name,
                 (SELECT max(order_date) FROM sv_orders o WHERE o.client_id = c.client_id) AS last_order_date,
                 (SELECT cast(arg_max(total_amount, (order_date, order_id)) AS double) FROM sv_orders o
                  WHERE o.client_id = c.client_id) AS last_total
               FROM sv_clients c"""
        ),
    ),
    query(
        "subq_where_client_avg",
        lambda s, d: composed.orders_above_client_average(star_shop(s, d)),
        sql(
            f"""SELECT order_id, client_id, {_TOTAL} AS total_amount FROM sv_orders o
                WHERE {_TOTAL} > (SELECT cast(sum(a.total_amount) AS double) / count(a.total_amount)
                                  FROM sv_orders a WHERE a.client_id = o.client_id)"""
        ),
    ),
    query(
        "temp_stage_sales",
        lambda s, d: composed.staged_sales(star_shop(s, d)),
        sql(
            """SELECT p.manufacturer, count(DISTINCT p.part_id) AS part_count, count(*) AS line_count,
                      cast(sum(l.quantity) AS bigint) AS quantity
               FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id GROUP BY p.manufacturer"""
        ),
    ),
    query(
        "cte_monthly_top_services",
        lambda s, d: composed.monthly_top_services(star_shop(s, d)),
        sql(
            "SELECT month, place, service_name, times FROM ranked WHERE place <= 3",
            """
            counted AS (
              SELECT cast(date_trunc('month', o.order_date) AS date) AS month, s.service_name, count(*) AS times
              FROM sv_services_in_orders l JOIN sv_orders o ON o.order_id = l.order_id
              JOIN sv_services s ON s.service_id = l.service_id GROUP BY 1, 2),
            ranked AS (
              SELECT *, row_number() OVER (PARTITION BY month ORDER BY times DESC, service_name) AS place
              FROM counted)""",
        ),
    ),
    query(
        "pivot_orders_by_payment",
        lambda s, d: composed.orders_by_month_and_payment(star_shop(s, d), PAYMENTS),
        sql(
            """SELECT cast(date_trunc('month', order_date) AS date) AS month,
                      count(*) FILTER (payment_type_id = 1) AS paid_f, count(*) FILTER (payment_type_id = 2) AS paid_o,
                      count(*) FILTER (payment_type_id = 3) AS paid_p
               FROM sv_orders GROUP BY 1"""
        ),
    ),
    query(
        "unpivot_columns",
        lambda s, d: composed.part_facts_as_rows(star_shop(s, d)),
        sql(
            """SELECT part_id, 'price' AS fact, cast(price AS double) AS value FROM sv_parts
               UNION ALL SELECT part_id, 'stock_quantity', cast(stock_quantity AS double) FROM sv_parts"""
        ),
    ),
    query(
        "lateral_last_orders",
        lambda s, d: composed.last_orders_per_client(star_shop(s, d)),
        sql(
            """SELECT c.client_id, c.full_name, l.place, l.order_id, l.order_date,
                      cast(l.total_amount AS double) AS total_amount
               FROM sv_clients c JOIN (
                 SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY order_date DESC, order_id DESC) AS place
                 FROM sv_orders) l ON l.client_id = c.client_id AND l.place <= 3"""
        ),
    ),
    query(
        "revenue_rollup",
        lambda s, d: composed.revenue_rollup(star_shop(s, d)),
        _grouping("ROLLUP (manufacturer, part_name)"),
    ),
    query(
        "revenue_cube",
        lambda s, d: composed.revenue_cube(star_shop(s, d)),
        _grouping("CUBE (manufacturer, part_name)"),
    ),
    query(
        "revenue_grouping_sets",
        lambda s, d: composed.revenue_grouping_sets(star_shop(s, d)),
        _grouping("GROUPING SETS ((manufacturer), (part_name), ())"),
    ),
    query(
        "page_limit_offset",
        lambda s, d: composed.page(_orders(s, d), ["order_date", "order_id"], 40, 20),
        sql(f"SELECT {ORDER_COLUMNS} FROM sv_orders ORDER BY order_date, order_id LIMIT 20 OFFSET 40"),
    ),
    query(
        "page_deep",
        lambda s, d: composed.page_deep(_orders(s, d), ["order_date", "order_id"], _orders(s, d).count() // 2, 50),
        sql(
            f"""SELECT {ORDER_COLUMNS} FROM sv_orders ORDER BY order_date, order_id
                LIMIT 50 OFFSET (SELECT count(*) // 2 FROM sv_orders)"""
        ),
    ),
    query(
        "top_n_fetch",
        lambda s, d: composed.top_orders(star_shop(s, d), 25),
        sql(
            f"""SELECT order_id, client_id, {_TOTAL} AS total_amount FROM sv_orders o
                ORDER BY o.total_amount DESC, order_id LIMIT 25"""
        ),
    ),
]
