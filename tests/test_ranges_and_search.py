"""Date ranges, name searches, deep pages, changed totals and hot references against plain code."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
from decimal import Decimal

import pytest

from tests.conftest import rows
from wrenchlake.operators import lookups, orders, references
from wrenchlake.plans import composed, ranges, search
from wrenchlake.session import new_shared_folder
from wrenchlake.sources.starmap import star_shop

DAY = dt.date(1999, 12, 28)
PARTS = "part_id long, part_name string, manufacturer string, price decimal(10,2), stock_quantity int"


def test_ranges_equal_a_count_per_request(make):
    rng = random.Random(3)
    daily = [(rng.randrange(12), rng.randrange(40), rng.randrange(1, 9)) for _ in range(150)]
    daily = [(i, d, n) for (i, d), n in {(i, d): n for i, d, n in daily}.items()]
    asked = [(k, rng.randrange(-3, 45), rng.randrange(-3, 45)) for k in range(200)] + [(500, 0, 0), (501, 39, 39), (502, None, 5), (503, 3, None)]
    at = lambda d: None if d is None else DAY + dt.timedelta(days=d)
    requests = make([(k, at(a), at(b)) for k, a, b in asked], "request_id long, first_day date, last_day date")
    base = (DAY - dt.date(1, 1, 1)).days
    table = make([(i, d + base, n) for i, d, n in daily], "item long, day int, n long")
    want = []
    for k, a, b in asked:
        met = [(i, n) for i, d, n in daily if a is not None and b is not None and a <= d <= b]
        want.append((k, len({i for i, _ in met}), sum(n for _, n in met)))
    assert rows(ranges._by_request(requests, table, "item", ["n"])) == sorted(want, key=repr)
    assert rows(ranges._by_request(requests, table.limit(0), "item", ["n"]), "distinct", "n") == [(0, 0)] * len(asked)
    assert ranges._by_request(requests.limit(0), table, "item", ["n"]).count() == 0


def like(name, text):
    import re

    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text.strip(" "))
    return re.fullmatch(f".*{pattern}.*", name, re.S) is not None


def test_names_like_equal_a_comparison_of_all(make):
    names = [(1, "Ivan Petrov"), (2, "Petr Ivanov"), (3, "A%b_c\\d"), (4, ""), (5, None), (6, "Анна"), (6, "Ann")]
    texts = ["Ivan", " Petr ", "%", "", "_", "I%v", "_v", "zz", "n", "an", "b_c", "\\", "Анн", None, "van%Iv", "___________x", "Ivan", "A%%_d"]
    asked = list(enumerate(texts))
    got = rows(search.names_like(make(names, "id long, name string"), "id", "name", make(asked, "request_id int, text string")))
    want = [(k, i, n) for k, t in asked if t is not None for i, n in names if n is not None and like(n, t)]
    assert got == sorted(want, key=repr)
    assert search.names_like(make([], "id long, name string"), "id", "name", make(asked, "request_id int, text string")).count() == 0


def test_searching_names_multiplies_no_rows(spark, small):
    from wrenchlake.querybook.book import find

    plan = find("mechanic_names_like_requests").run(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_answers_to_a_common_text_are_made_by_many_tasks(make, monkeypatch):
    for name, value in (("TILE_REQUESTS", 20), ("TILE_NAMES", 10), ("TASK_ROWS", 200)):
        monkeypatch.setattr(search, name, value, raising=False)
    names = make([(k, f"name {k}") for k in range(60)], "id long, name string")
    asked = make([(k, "na" if k else "e 7") for k in range(201)], "request_id long, text string")
    got = search.names_like(names, "id", "name", asked)
    want = [(k, i, f"name {i}") for k in range(1, 201) for i in range(60)] + [(0, 7, "name 7")]
    assert rows(got) == sorted(want, key=repr)
    assert max(len(part) for part in got.rdd.glom().collect()) < 200 * 60 // 6


def test_answers_to_a_common_text_take_little_disk(spark, make):
    names = spark.range(12_000).selectExpr("id", "concat('name ', id) name")
    asked = spark.range(150).selectExpr("id request_id", "'name' text")
    path = new_shared_folder(spark)
    search.names_like(names, "id", "name", asked).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == back.distinct().count() == 150 * 12_000
    # A byte for two longs and a name: in the order of the requests they do not fit into that.
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet")) < 150 * 12_000


def test_requests_without_an_id_are_answered(make):
    names = make([(k, "same") for k in range(3)], "id long, name string")
    asked = make([(None, "a")] * 200 + [(7, "a")] * 200 + [(None, None), (None, "b")], "request_id long, text string")
    got = search.names_like(names, "id", "name", asked)
    assert rows(got) == sorted([(r, k, "same") for r in (None, 7) for k in range(3)] * 200, key=repr)


@pytest.mark.parametrize(("offset", "size"), [(0, 5), (37, 20), (95, 20), (100, 5), (400, 5), (50, 0)])
def test_deep_pages(make, offset, size):
    numbers = list(range(100))
    random.Random(1).shuffle(numbers)
    table = make([(n // 10, n) for n in numbers], "a int, b int").repartition(3)
    got = [tuple(r) for r in composed.page_deep(table, ["a", "b"], offset, size).collect()]
    assert got == [(n // 10, n) for n in range(100)][offset : offset + size]
    assert composed.page_deep(table.limit(0), ["a", "b"], 0, 5).count() == 0


def test_changed_totals(make):
    stored = make([(1, Decimal(100)), (2, Decimal(5)), (3, None), (4, Decimal(7))], "order_id long, total_amount decimal(12,2)")
    parts = make([(1, "a", "m", Decimal("2.50"), 1), (2, "b", "m", None, 1)], PARTS)
    services = make([(1, "s", Decimal(10))], "service_id long, service_name string, price decimal(10,2)")
    part_changes = make([(1, 1, 4), (1, 1, -2), (1, 2, 9), (1, 99, 9), (3, 1, 1), (9, 1, 1)], "order_id long, part_id long, quantity int")
    service_changes = make([(1, 1, 1), (2, 1, 1), (2, 1, -1)], "order_id long, service_id long, lines int")
    got = orders.change_totals(stored, part_changes, service_changes, parts, services)
    assert rows(got) == [(1, Decimal("115.00")), (2, Decimal("5.00")), (3, None), (4, Decimal("7.00"))]


def test_a_hot_reference_is_not_one_task(spark, make):
    """Broadcasts off, and 95 of 100 references name one part."""
    catalog = make([(k, f"p{k}", "m", None, 1) for k in range(500)], PARTS).withColumnRenamed("part_id", "id")
    asked = make([(k, "p7" if k % 20 else f"p{k % 700}", "m") for k in range(4000)], "request_id long, part_name string, manufacturer string")
    keys = ["part_name", "manufacturer"]
    plain = rows(asked.join(catalog, keys, "left"), "request_id", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = references.join_references(asked, catalog, keys, hot_rows=1000, broadcast_rows=100)
        assert rows(joined, "request_id", "id") == plain
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        # The shuffled side is without the hot rows.
        usual = asked.filter("part_name <> 'p7'").count()
        assert usual < 250
        looked = lookups.lookup_part_ids(asked, catalog.withColumnRenamed("id", "part_id"))
        assert "SortMergeJoin" not in looked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranges_over_the_shop(spark, small, make):
    shop = star_shop(spark, small)
    asked = make([(1, dt.date(1900, 1, 1), dt.date(2100, 1, 1)), (2, None, None)], "request_id long, first_day date, last_day date")
    used = shop.parts_in_orders.select("part_id").distinct().count()
    got = {r.request_id: r for r in ranges.parts_by_request(shop, asked).collect()}
    assert got[1].part_count == used and got[2].part_count == 0
