"""Plans keep the shape that makes them fit for large tables."""

from __future__ import annotations

import re

import pytest

from tests.conftest import rows
from wrenchlake.plans import reports
from wrenchlake.querybook.base import AS_OF
from wrenchlake.querybook.book import all_queries, find
from wrenchlake.sources import schemas
from wrenchlake.sources.starmap import star_shop
from wrenchlake.sources.tables import Shop, load_shop, save_shop

# These run jobs while they are being planned.
STAGED = {
    "stream_stock_after_sales",
    "stock_after_single_sales",
    "stock_after_whole_orders",
    "upsert_clients_from_view",
    "upsert_cars_from_view",
    "rejects_report",
    "add_parts_in_sequence",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [q.name for q in all_queries() if q.name not in STAGED])
def test_no_query_multiplies_rows_or_uses_python(name, spark, small):
    plan = plan_of(find(name).run(spark, small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "InPandas" not in plan


def test_report_prunes_columns_and_pushes_the_date(spark, small):
    plan = find("report_parts_sold").run(spark, small)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(o_orderdate,2001-07-02T00:00)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_linestatus:string>" in plan


def test_lines_are_summed_before_the_catalogue_is_joined(spark, small):
    plan = plan_of(reports.parts_sold(star_shop(spark, small), AS_OF))
    per_part = re.search(r"HashAggregate\(keys=\[part_id#\d+L\], functions=\[partial_sum", plan)
    assert per_part is not None


def test_newest_orders_are_limited_before_the_shuffle(spark, small):
    assert plan_of(find("lateral_last_orders").run(spark, small)).count("WindowGroupLimit") == 2


def test_saved_shop_reads_back(spark, small, tmp_path):
    shop = star_shop(spark, small)
    save_shop(shop, str(tmp_path / "shop"))
    again = load_shop(spark, str(tmp_path / "shop"))
    for name, schema in schemas.TABLES.items():
        table = getattr(again, name)
        assert table.schema.simpleString() == schema.simpleString()
        assert table.count() == getattr(shop, name).count()
    assert rows(reports.parts_sold(again, AS_OF)) == rows(reports.parts_sold(shop, AS_OF))
    again.register("saved_")
    assert spark.table("saved_orders").count() == shop.orders.count()


def test_empty_window_has_count_zero_and_no_sum(spark, small):
    shop = star_shop(spark, small)
    later = AS_OF.replace(year=2030)
    summary = reports.recent_orders_summary(shop, later).first()
    assert (summary.order_count, summary.total_sum) == (0, None)
    sold = reports.parts_sold_summary(shop, later).first()
    assert (sold.part_count, sold.total_revenue) == (0, None)
    done = reports.popular_services_summary(shop, later, later).first()
    assert (done.service_count, float(done.total_sum)) == (0, 0.0)
    assert reports.parts_sold(shop, later).count() == 0


def test_namesakes_are_merged(spark, make):
    shop = Shop(
        orders=make([(1,)], "order_id long").selectExpr("order_id", "date'2001-08-01' AS order_date"),
        services_in_orders=make(
            [(1, 1, 1, 2), (1, 1, 2, 3), (1, 9, 2, 7), (1, 1, None, 1)],
            "order_id long, service_id long, mechanic_id long, quantity int",
        ),
        services=make([(1, "wash")], "service_id long, service_name string").selectExpr(
            "*", "cast(10 AS decimal(10,2)) AS price"
        ),
        mechanics=make([(1, "Max"), (2, "Max")], "mechanic_id long, full_name string"),
    )
    load = reports.mechanic_load(shop, AS_OF).collect()
    assert [(r.full_name, r.service_count, float(r.total_sum)) for r in load] == [("Max", 2, 50.0)]
    summary = reports.mechanic_load_summary(shop, AS_OF).first()
    assert (summary.mechanic_count, summary.total_services) == (2, 12)  # the unknown service counts here
    services = reports.popular_services(shop, AS_OF, AS_OF).collect()
    assert [(r.service_name, r.times_done, float(r.total_sum)) for r in services] == [("wash", 3, 30.0)]


def test_shop_names_its_missing_tables():
    with pytest.raises(ValueError):
        Shop(pets=None)
    with pytest.raises(AttributeError):
        Shop().orders
