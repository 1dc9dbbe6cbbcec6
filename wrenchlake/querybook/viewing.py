"""Scans, lookups, joined views and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wrenchlake.functions import text
from wrenchlake.operators import contacts
from wrenchlake.plans import ranges, reports, search, views
from wrenchlake.querybook.base import AS_OF, ORDER_COLUMNS, PART_COLUMNS, SINCE, Query, query, sql
from wrenchlake.sources import requests
from wrenchlake.sources.starmap import star_shop

FIRST_DAY = dt.date(2001, 3, 1)
LAST_DAY = dt.date(2001, 5, 31)

_SCANS = {
    "clients": "client_id, full_name, phone",
    "cars": "car_id, owner_id, model, color, license_plate",
    "mechanics": "mechanic_id, full_name, phone_number, qualification, cast(salary AS double) AS salary, "
    "cast(experience AS bigint) AS experience",
    "parts": PART_COLUMNS,
    "services": "service_id, service_name, cast(price AS double) AS price",
    "orders": ORDER_COLUMNS,
    "parts_in_orders": "order_id, part_id, cast(quantity AS bigint) AS quantity",
    "services_in_orders": "order_id, service_id, mechanic_id, cast(quantity AS bigint) AS quantity",
    "workplaces": "workplace_id, workplace_type",
    "payment_types": "payment_type_id, payment_name",
}


def _scan(table: str):
    return lambda spark, sf_dir: getattr(star_shop(spark, sf_dir), table)


def _param_first_row(spark: SparkSession, sf_dir: str):
    orders = star_shop(spark, sf_dir).orders
    orders.createOrReplaceTempView("param_orders")
    rows = spark.sql("SELECT * FROM param_orders WHERE total_amount >= :least", args={"least": 400000})
    return views.first_row(rows, "order_id")


def _search_terms(spark: SparkSession, sf_dir: str):
    """Every part name of one maker serves as a search text, with stray blanks around it."""
    parts = star_shop(spark, sf_dir).parts
    return parts.filter(F.col("manufacturer") == "Brand#7").select(F.concat(F.lit(" "), "part_name").alias("term"))


def _typed(spark: SparkSession, sf_dir: str):
    return requests.typed_contacts(spark, sf_dir)


def _labels(spark: SparkSession, sf_dir: str):
    shop = star_shop(spark, sf_dir)
    cars = shop.cars.select(
        F.lit("car").alias("kind"),
        F.col("car_id").alias("id"),
        text.car_label(F.col("model"), F.col("color"), F.col("license_plate")).alias("label"),
    )
    parts = shop.parts.select(
        F.lit("part").alias("kind"),
        F.col("part_id").alias("id"),
        text.part_label(F.col("manufacturer"), F.col("part_name"), F.col("price")).alias("label"),
    )
    services = shop.services.select(
        F.lit("service").alias("kind"),
        F.col("service_id").alias("id"),
        text.service_label(F.col("service_name"), F.col("price")).alias("label"),
    )
    return cars.unionByName(parts).unionByName(services)


def _split_labels(spark: SparkSession, sf_dir: str):
    label = F.col("label")
    return (
        _labels(spark, sf_dir)
        .filter(F.col("kind") == "car")
        .select("id", text.label_first(label).alias("model"), text.label_last(label).alias("license_plate"))
    )


TYPED_SQL = """
typed AS (
  SELECT c_custkey AS request_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'mechanic' ELSE 'client' END AS role,
         CASE WHEN c_mktsegment = 'BUILDING' THEN substring(t, 1, 17) ELSE t END AS typed_phone
  FROM (SELECT c_custkey, c_mktsegment,
               regexp_replace(lpad(cast(c_custkey AS varchar(20)), 10, '0'),
                              '^(...)(...)(..)(..)$', '+7 (\\1) \\2-\\3-\\4') AS t FROM customer)
  UNION ALL
  SELECT s_suppkey + 1000000000, 'mechanic',
         regexp_replace(lpad(cast(s_suppkey AS varchar(20)), 10, '9'),
                        '^(...)(...)(..)(..)$', '+7 (\\1) \\2-\\3-\\4')
  FROM supplier)"""

_NORMAL = "CASE WHEN length(typed_phone) = 18 THEN regexp_replace(typed_phone, '[-() ]', '', 'g') END"

RANGE_STEPS = """
ranges AS (
  SELECT request_id, CASE d WHEN 1 THEN day - 30 WHEN 2 THEN day WHEN 3 THEN day WHEN 5 THEN day END AS first_day,
         CASE d WHEN 3 THEN day - 1 WHEN 5 THEN day + 365 ELSE day END AS last_day
  FROM (SELECT o_orderkey AS request_id, cast(o_orderdate AS date) AS day,
               cast(substring(o_orderpriority, 1, 1) AS int) AS d FROM orders))"""

QUERIES: list[Query] = [
    *[query(f"scan_{t}", _scan(t), sql(f"SELECT {columns} FROM sv_{t}")) for t, columns in _SCANS.items()],
    query(
        "catalog_parts",
        lambda s, d: star_shop(s, d).parts.select("part_id", "manufacturer", "part_name", "price"),
        sql("SELECT part_id, manufacturer, part_name, cast(price AS double) AS price FROM sv_parts"),
    ),
    query(
        "catalog_services",
        lambda s, d: star_shop(s, d).services.select("service_id", "service_name", "price"),
        sql("SELECT service_id, service_name, cast(price AS double) AS price FROM sv_services"),
    ),
    query(
        "param_first_row",
        _param_first_row,
        sql(f"SELECT {ORDER_COLUMNS} FROM sv_orders WHERE total_amount >= 400000 ORDER BY order_id LIMIT 1"),
    ),
    query(
        "client_card",
        lambda s, d: views.client_cards(star_shop(s, d), reports.recent_orders(star_shop(s, d), AS_OF)),
        sql(
            f"""SELECT client_id, full_name, phone FROM sv_clients
                WHERE client_id IN (SELECT client_id FROM sv_orders WHERE order_date >= {SINCE})"""
        ),
    ),
    query(
        "car_full_info",
        lambda s, d: views.car_full_info(star_shop(s, d)),
        sql(
            """SELECT client_id, full_name, phone, car_id, model, color, license_plate
               FROM sv_clients JOIN sv_cars ON client_id = owner_id"""
        ),
    ),
    query(
        "client_orders_view",
        lambda s, d: views.client_orders(star_shop(s, d)),
        sql(
            """SELECT o.order_id, o.order_date, cast(o.total_amount AS double) AS total_amount, c.client_id,
                      c.full_name AS client_name, c.phone AS client_phone
               FROM sv_orders o JOIN sv_clients c ON c.client_id = o.client_id"""
        ),
    ),
    query(
        "parts_in_order_view",
        lambda s, d: views.parts_in_order(star_shop(s, d)),
        sql(
            """SELECT l.order_id, l.part_id, p.part_name, cast(l.quantity AS bigint) AS quantity
               FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id"""
        ),
    ),
    query(
        "client_order_history",
        lambda s, d: views.client_order_history(star_shop(s, d)),
        sql(
            """SELECT o.client_id, o.order_date, c.model, c.license_plate, m.phone_number AS mechanic_phone,
                      cast(o.total_amount AS double) AS total_amount
               FROM sv_orders o JOIN sv_cars c ON c.car_id = o.car_id
               JOIN sv_services_in_orders l ON l.order_id = o.order_id
               JOIN sv_mechanics m ON m.mechanic_id = l.mechanic_id"""
        ),
    ),
    query(
        "mechanic_recent_orders",
        lambda s, d: views.mechanic_recent_orders(star_shop(s, d), AS_OF),
        sql(
            f"""SELECT l.order_id, s.service_name, o.order_date, cast(o.total_amount AS double) AS total_amount,
                       l.mechanic_id
                FROM sv_services_in_orders l JOIN sv_services s ON s.service_id = l.service_id
                JOIN sv_orders o ON o.order_id = l.order_id WHERE o.order_date >= {SINCE}"""
        ),
    ),
    query(
        "parts_by_name",
        lambda s, d: views.parts_by_name(star_shop(s, d), _search_terms(s, d)),
        sql(
            f"""SELECT {PART_COLUMNS} FROM sv_parts
                WHERE part_name IN (SELECT part_name FROM sv_parts WHERE manufacturer = 'Brand#7')"""
        ),
    ),
    query(
        "orders_by_client_name",
        lambda s, d: views.orders_by_client_name(star_shop(s, d), star_shop(s, d).clients.select("full_name")),
        sql(
            f"""SELECT n.full_name, {ORDER_COLUMNS.replace("client_id", "o.client_id")} FROM sv_orders o
                JOIN (SELECT full_name, min(client_id) AS client_id FROM sv_clients GROUP BY full_name) n
                ON n.client_id = o.client_id"""
        ),
    ),
    query(
        "mechanic_name_like",
        lambda s, d: star_shop(s, d)
        .mechanics.filter(text.like_anywhere(F.col("full_name"), " 0_7 "))
        .select("mechanic_id", "full_name"),
        sql("SELECT mechanic_id, full_name FROM sv_mechanics WHERE full_name LIKE '%0_7%'"),
    ),
    query(
        "clients_without_orders",
        lambda s, d: views.clients_without_orders(star_shop(s, d)),
        sql(
            """SELECT client_id, full_name, phone FROM sv_clients c
               WHERE NOT EXISTS (SELECT 1 FROM sv_orders o WHERE o.client_id = c.client_id)"""
        ),
    ),
    query(
        "parts_used",
        lambda s, d: views.parts_used(star_shop(s, d).parts, star_shop(s, d).parts_in_orders),
        sql(
            f"""SELECT {PART_COLUMNS} FROM sv_parts p WHERE EXISTS (
                  SELECT 1 FROM sv_parts_in_orders l WHERE l.part_id = p.part_id)"""
        ),
    ),
    query(
        "match_contacts",
        lambda s, d: contacts.match_contacts(_typed(s, d), star_shop(s, d).clients, star_shop(s, d).mechanics),
        sql(
            """SELECT t.request_id, t.role, t.phone, p.person_id,
                      CASE WHEN t.phone IS NULL THEN 'bad_phone' WHEN p.person_id IS NULL THEN 'client_not_found'
                           ELSE 'ok' END AS status
               FROM normal t LEFT JOIN people p ON p.role = t.role AND p.phone = t.phone""",
            f"""{TYPED_SQL},
            normal AS (SELECT request_id, role, {_NORMAL} AS phone FROM typed),
            people AS (
              SELECT 'client' AS role, phone, min(client_id) AS person_id FROM sv_clients GROUP BY phone
              UNION ALL
              SELECT 'mechanic', phone_number, min(mechanic_id) FROM sv_mechanics GROUP BY phone_number)""",
        ),
    ),
    query(
        "normalize_phones",
        lambda s, d: contacts.normalize_phones(_typed(s, d)),
        sql(f"SELECT request_id, role, typed_phone, {_NORMAL} AS phone FROM typed", TYPED_SQL),
    ),
    query(
        "validate_phones",
        lambda s, d: contacts.validate_phones(
            requests.phone_changes(s, d).select("request_id", F.col("new_phone").alias("phone"))
        ),
        sql(
            r"""SELECT c_custkey AS request_id, phone, coalesce(regexp_full_match(phone, '\+7[0-9]{10}'), false) AS valid
                FROM (SELECT c_custkey, CASE c_mktsegment
                        WHEN 'AUTOMOBILE' THEN concat('+7', lpad(cast(c_custkey AS varchar(20)), 10, '5'))
                        WHEN 'BUILDING' THEN '+799912368'
                        WHEN 'FURNITURE' THEN concat('+7', lpad(cast(c_custkey AS varchar(20)), 10, '0'))
                        ELSE concat('+78', lpad(cast(c_custkey // 2 AS varchar(20)), 9, '0')) END AS phone
                      FROM customer)"""
        ),
    ),
    query(
        "display_labels",
        _labels,
        sql(
            """SELECT 'car' AS kind, car_id AS id, model || ' - ' || color || ' - ' || license_plate AS label FROM sv_cars
               UNION ALL
               SELECT 'part', part_id, manufacturer || ' - ' || part_name || ' (' || cast(price AS varchar) || '₽)'
               FROM sv_parts
               UNION ALL
               SELECT 'service', service_id, service_name || ' (' || cast(price AS varchar) || '₽)' FROM sv_services"""
        ),
    ),
    query(
        "split_labels",
        _split_labels,
        sql("SELECT car_id AS id, model, license_plate FROM sv_cars"),
    ),
    query(
        "sort_table",
        lambda s, d: views.sort_table(star_shop(s, d).parts, "price", descending=True, tie="part_id"),
        sql(f"SELECT {PART_COLUMNS} FROM sv_parts ORDER BY price DESC, part_id"),
    ),
    query(
        "recent_orders",
        lambda s, d: reports.recent_orders(star_shop(s, d), AS_OF),
        sql(f"SELECT {ORDER_COLUMNS} FROM sv_orders WHERE order_date >= {SINCE} ORDER BY order_date DESC, order_id"),
    ),
    query(
        "recent_orders_summary",
        lambda s, d: reports.recent_orders_summary(star_shop(s, d), AS_OF),
        sql(
            f"""SELECT count(*) AS order_count, cast(sum(total_amount) AS double) AS total_sum
                FROM sv_orders WHERE order_date >= {SINCE}"""
        ),
    ),
    query(
        "report_parts_sold",
        lambda s, d: reports.parts_sold(star_shop(s, d), AS_OF),
        sql(
            f"""SELECT p.part_name, cast(sum(l.quantity) AS bigint) AS quantity_sold,
                       cast(sum(l.quantity * p.price) AS double) AS revenue
                FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id
                JOIN sv_orders o ON o.order_id = l.order_id WHERE o.order_date >= {SINCE}
                GROUP BY p.part_name ORDER BY quantity_sold DESC, p.part_name"""
        ),
    ),
    query(
        "report_parts_sold_summary",
        lambda s, d: reports.parts_sold_summary(star_shop(s, d), AS_OF),
        sql(
            f"""SELECT count(DISTINCT l.part_id) AS part_count,
                       cast(sum(l.quantity * p.price) AS double) AS total_revenue
                FROM sv_parts_in_orders l JOIN sv_parts p ON p.part_id = l.part_id
                JOIN sv_orders o ON o.order_id = l.order_id WHERE o.order_date >= {SINCE}"""
        ),
    ),
    query(
        "report_services",
        lambda s, d: reports.popular_services(star_shop(s, d), FIRST_DAY, LAST_DAY),
        sql(
            """SELECT s.service_name, count(*) AS times_done, cast(sum(s.price) AS double) AS total_sum
               FROM sv_services_in_orders l JOIN sv_services s ON s.service_id = l.service_id
               JOIN sv_orders o ON o.order_id = l.order_id
               WHERE o.order_date BETWEEN date '2001-03-01' AND date '2001-05-31'
               GROUP BY s.service_name ORDER BY times_done DESC, s.service_name"""
        ),
    ),
    query(
        "report_services_summary",
        lambda s, d: reports.popular_services_summary(star_shop(s, d), FIRST_DAY, LAST_DAY),
        sql(
            """SELECT count(DISTINCT s.service_id) AS service_count,
                      cast(coalesce(sum(s.price), 0) AS double) AS total_sum
               FROM sv_services_in_orders l JOIN sv_services s ON s.service_id = l.service_id
               JOIN sv_orders o ON o.order_id = l.order_id
               WHERE o.order_date BETWEEN date '2001-03-01' AND date '2001-05-31'"""
        ),
    ),
    *[
        query(
            f"report_mechanic_load{suffix}",
            (lambda name: lambda s, d: reports.mechanic_load(star_shop(s, d), AS_OF, name))(name),
            sql(
                f"""SELECT m.full_name, count(*) AS service_count,
                           cast(sum(l.quantity * s.price) AS double) AS total_sum
                    FROM sv_services_in_orders l JOIN sv_services s ON s.service_id = l.service_id
                    JOIN sv_mechanics m ON m.mechanic_id = l.mechanic_id
                    JOIN sv_orders o ON o.order_id = l.order_id
                    WHERE o.order_date >= {SINCE} AND m.full_name LIKE '%{name}%'
                    GROUP BY m.full_name ORDER BY service_count DESC, m.full_name"""
            ),
        )
        for suffix, name in (("", ""), ("_by_name", "07"))
    ],
    query(
        "report_mechanic_load_summary",
        lambda s, d: reports.mechanic_load_summary(star_shop(s, d), AS_OF),
        sql(
            f"""SELECT count(DISTINCT l.mechanic_id) AS mechanic_count,
                       cast(sum(l.quantity) AS bigint) AS total_services
                FROM sv_services_in_orders l JOIN sv_mechanics m ON m.mechanic_id = l.mechanic_id
                JOIN sv_orders o ON o.order_id = l.order_id WHERE o.order_date >= {SINCE}"""
        ),
    ),
    query(
        "report_services_by_request",
        lambda s, d: ranges.services_by_request(star_shop(s, d), requests.date_ranges(s, d)),
        sql(
            """SELECT r.request_id, coalesce(a.service_count, 0) AS service_count, coalesce(a.times_done, 0) AS times_done,
                      coalesce(a.total_sum, 0.0) AS total_sum
               FROM ranges r LEFT JOIN (
                 SELECT p.first_day, p.last_day, count(DISTINCT u.service_id) AS service_count, count(*) AS times_done,
                        cast(sum(s.price) AS double) AS total_sum
                 FROM (SELECT DISTINCT first_day, last_day FROM ranges) p
                 JOIN sv_orders o ON o.order_date >= p.first_day AND o.order_date <= p.last_day
                 JOIN sv_services_in_orders u ON u.order_id = o.order_id
                 JOIN sv_services s ON s.service_id = u.service_id GROUP BY p.first_day, p.last_day) a
               ON a.first_day = r.first_day AND a.last_day = r.last_day""",
            RANGE_STEPS,
        ),
    ),
    query(
        "report_parts_by_request",
        lambda s, d: ranges.parts_by_request(star_shop(s, d), requests.date_ranges(s, d)),
        sql(
            """SELECT r.request_id, coalesce(a.part_count, 0) AS part_count, cast(coalesce(a.quantity_sold, 0) AS bigint) AS quantity_sold,
                      coalesce(a.revenue, 0.0) AS revenue
               FROM ranges r LEFT JOIN (
                 SELECT q.first_day, q.last_day, count(DISTINCT l.part_id) AS part_count, sum(l.quantity) AS quantity_sold,
                        cast(sum(l.quantity * p.price) AS double) AS revenue
                 FROM (SELECT DISTINCT first_day, last_day FROM ranges) q
                 JOIN sv_orders o ON o.order_date >= q.first_day AND o.order_date <= q.last_day
                 JOIN sv_parts_in_orders l ON l.order_id = o.order_id
                 JOIN sv_parts p ON p.part_id = l.part_id GROUP BY q.first_day, q.last_day) a
               ON a.first_day = r.first_day AND a.last_day = r.last_day""",
            RANGE_STEPS,
        ),
    ),
    query(
        "mechanic_names_like_requests",
        lambda s, d: search.names_like(star_shop(s, d).mechanics, "mechanic_id", "full_name", requests.search_texts(s, d)),
        sql(
            """SELECT t.request_id, m.mechanic_id, m.full_name
               FROM texts t JOIN sv_mechanics m ON m.full_name LIKE '%' || trim(t.text) || '%'""",
            """
texts AS (
  SELECT c_custkey AS request_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '  ' || lpad(cast(c_custkey % 100 AS varchar), 2, '0') || ' '
           WHEN 'BUILDING' THEN lpad(cast(c_custkey % 1000 AS varchar), 3, '0')
           WHEN 'FURNITURE' THEN 'r#%0_' || cast(c_custkey % 10 AS varchar)
           WHEN 'HOUSEHOLD' THEN 'no ' || lpad(cast(c_custkey % 100 AS varchar), 2, '0')
           WHEN 'MACHINERY' THEN CASE WHEN c_custkey % 50 = 0 THEN '' ELSE cast(c_custkey % 10 AS varchar) END END AS text
  FROM customer)""",
        ),
    ),
]
