from __future__ import annotations

from decimal import Decimal

import pytest

from tests.conftest import rows
from wrenchlake.operators import lookups, orders, pricing

PARTS = "part_id long, part_name string, manufacturer string, price decimal(10,2), stock_quantity int"
SERVICES = "service_id long, service_name string, price decimal(10,2)"
REF = "array<struct<part_name:string,manufacturer:string>>"


@pytest.fixture
def parts(make):
    return make(
        [
            (1, "oil filter", "Bosch", Decimal("900.00"), 10),
            (2, "spark plug", "Bosch", Decimal("700.00"), 5),
            (3, "air filter", "Valeo", Decimal("1200.00"), None),
            (4, "air filter", "Valeo", Decimal("99.00"), 1),
            (5, "unpriced", "Bosch", None, 1),
        ],
        PARTS,
    )


@pytest.fixture
def services(make):
    return make(
        [(1, "body paint", Decimal("22000.00")), (2, "oil change", Decimal("2800.00")), (3, "unpriced", None)], SERVICES
    )


def answers(df):
    return {r.request_id: (None if r.total is None else float(r.total), r.status) for r in df.collect()}


def test_names_resolve_to_the_lowest_id(make, parts):
    asked = make(
        [(1, "air filter", "Valeo"), (2, "Valeo", "air filter"), (3, None, "Valeo")],
        "request_id long, part_name string, manufacturer string",
    )
    got = lookups.lookup_part_ids(asked, parts)
    assert rows(got, "request_id", "part_id", "status") == [
        (1, 3, "ok"),
        (2, None, "part_not_found"),
        (3, None, "part_not_found"),
    ]
    with pytest.raises(Exception, match="part_not_found"):
        lookups.lookup_part_ids(asked, parts, strict=True).collect()


def test_lists_keep_order_and_repeats(make, parts):
    asked = make(
        [(1, [("spark plug", "Bosch"), ("nothing", "Bosch"), ("spark plug", "Bosch")]), (2, []), (3, None)],
        f"request_id long, parts {REF}",
    )
    got = lookups.resolve_part_list(asked, parts)
    assert rows(got.found, "request_id", "pos", "part_id") == [(1, 0, 2), (1, 2, 2)]
    assert rows(got.rejects) == [(1, 1, "part_not_found"), (3, None, "null_list")]


def test_totals_by_ids(make, parts, services):
    asked = make(
        [
            (1, [1, 1, 2], [1, 2]),
            (2, [1, 99], [2]),
            (3, [], []),
            (4, None, None),
            (5, [5], [3]),
            (6, [1, None], [2]),
        ],
        "request_id long, part_ids array<long>, service_ids array<long>",
    )
    assert answers(pricing.parts_price_by_ids(asked, parts)) == {
        1: (2500.0, "ok"),
        2: (None, "part_not_found"),
        3: (0.0, "ok"),
        4: (None, "null_list"),
        5: (None, "part_not_found"),
        6: (None, "part_not_found"),
    }
    assert answers(pricing.services_price_by_ids(asked, services))[1] == (24800.0, "ok")
    assert answers(pricing.quote_by_ids(asked, parts, services)) == {
        1: (27300.0, "ok"),
        2: (None, "part_not_found"),
        3: (0.0, "ok"),
        4: (0.0, "ok"),
        5: (None, "part_not_found"),
        6: (None, "part_not_found"),
    }
    with pytest.raises(Exception, match="not_found"):
        pricing.quote_by_ids(asked, parts, services, strict=True).collect()


def test_totals_by_names(make, parts, services):
    three = [("oil filter", "Bosch"), ("spark plug", "Bosch"), ("air filter", "Valeo")]
    asked = make(
        [
            (1, three, ["body paint", "oil change"]),
            (2, [("nothing", "Bosch")], ["nothing"]),
            (3, [], None),
            (4, [("unpriced", "Bosch")], []),
        ],
        f"request_id long, parts {REF}, service_names array<string>",
    )
    assert answers(pricing.parts_price_by_names(asked, parts)) == {
        1: (2800.0, "ok"),
        2: (0.0, "ok"),
        3: (0.0, "ok"),
        4: (None, "part_not_found"),
    }
    assert answers(pricing.services_price_by_names(asked, services)) == {
        1: (24800.0, "ok"),
        2: (0.0, "ok"),
        3: (None, "null_list"),
        4: (0.0, "ok"),
    }
    assert answers(pricing.quote_by_names(asked, parts, services)) == {
        1: (27600.0, "ok"),
        2: (0.0, "ok"),
        3: (None, "null_list"),
        4: (None, "part_not_found"),
    }


def test_quote_with_quantity(make, parts, services):
    asked = make(
        [(1, [1, 2], [1, 3], [1], [10]), (2, [], [], [2], [1, 4]), (3, None, None, [], []), (4, [9], [1], [1], [1])],
        "request_id long, service_ids array<long>, service_qty array<int>, part_ids array<long>, part_qty array<int>",
    )
    got = answers(pricing.quote_with_quantity(asked, parts, services))
    assert got[1] == (22000.0 + 3 * 2800.0 + 9000.0, "ok")
    assert got[2] == (None, "part_not_found")  # a quantity without an id
    assert got[3] == (0.0, "ok")
    assert got[4] == (None, "service_not_found")


def test_order_totals_ignore_service_quantity_and_do_not_fan_out(make, parts, services):
    stored = make([(5, Decimal("1.00")), (6, None)], "order_id long, total_amount decimal(12,2)")
    part_lines = make([(5, 1, 2), (5, 2, 1), (77, 1, 1)], "order_id long, part_id long, quantity int")
    service_lines = make(
        [(5, 2, 1, 9), (5, 2, None, 9)], "order_id long, service_id long, mechanic_id long, quantity int"
    )
    amounts = pricing.order_amounts(stored, part_lines, service_lines, parts, services)
    assert rows(amounts) == [(5, Decimal("8100.00")), (6, Decimal("0.00"))]
    ids = make([(5,), (404,)], "order_id long")
    assert rows(pricing.totals_for_ids(ids, amounts)) == [(404, Decimal("0.00")), (5, Decimal("8100.00"))]
    carried = pricing.order_amounts(stored, part_lines, service_lines, parts, services, ["total_amount"])
    assert rows(orders.totals_diff(carried)) == [(5, Decimal("1.00"), Decimal("8100.00")), (6, None, Decimal("0.00"))]
    assert rows(orders.recalculate_all(stored, carried)) == [(5, Decimal("8100.00")), (6, Decimal("0.00"))]
    listed = pricing.order_amounts_of(
        make([(6,), (404,)], "order_id long"), stored, part_lines, service_lines, parts, services
    )
    assert rows(listed) == [(6, Decimal("0.00"))]
    after = orders.recalculate_listed(stored, listed)
    assert rows(after) == [(5, Decimal("1.00")), (6, Decimal("0.00"))]


@pytest.mark.parametrize("short", [100_000, 2])
def test_listed_orders_are_summed_without_sorting_their_lines(make, parts, services, monkeypatch, short):
    monkeypatch.setattr(pricing, "SHORT_LIST", short, raising=False)
    stored = make([(5,), (6,), (7,), (None,)], "order_id long")
    part_lines = make([(5, 1, 2), (5, 2, 1), (7, 1, 1), (None, 1, 1)], "order_id long, part_id long, quantity int")
    service_lines = make([(5, 2, 1, 9), (404, 2, None, 9)], "order_id long, service_id long, mechanic_id long, quantity int")
    ids = make([(5,), (6,), (5,), (404,), (None,)], "order_id long")
    listed = pricing.order_amounts_of(ids, stored, part_lines, service_lines, parts, services)
    assert rows(listed) == [(5, Decimal("5300.00")), (6, Decimal("0.00"))]
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == (short > 2)


def test_adding_parts_is_all_or_nothing(make, parts):
    line = "array<struct<manufacturer:string,part_name:string,quantity:int>>"
    asked = make(
        [
            (1, 100, [("Bosch", "oil filter", 2), ("Bosch", "spark plug", 4)]),
            (2, 100, [("oil filter", "Bosch", 2), ("Bosch", "spark plug", 4)]),
            (3, 100, [("Bosch", "oil filter", 20000)]),
            (4, 100, [("Bosch", "spark plug", 3), ("Bosch", "spark plug", 3)]),
            (5, 100, [("Valeo", "air filter", 1000)]),
            (6, 100, []),
            (7, 100, None),
        ],
        f"request_id long, order_id long, parts {line}",
    )
    got = orders.add_parts_to_orders(asked, parts)
    assert rows(got.lines, "request_id", "pos", "part_id", "quantity") == [(1, 0, 1, 2), (1, 1, 2, 4), (5, 0, 3, 1000)]
    assert rows(got.rejects) == [
        (2, "part_not_found"),
        (3, "insufficient_stock"),
        (4, "insufficient_stock"),
        (7, "null_list"),
    ]


def test_adding_parts_in_sequence(make, parts):
    line = "array<struct<manufacturer:string,part_name:string,quantity:int>>"
    oil, plug = ("Bosch", "oil filter"), ("Bosch", "spark plug")
    wanted = {
        1: [(*oil, 6)],
        2: [(*oil, 5), (*plug, 5)],  # the oil is short after 1, so the plugs stay
        3: [(*plug, 3)],
        4: [(*plug, 3)],  # short after 3
        5: [(*oil, 4), (*plug, 2)],
        6: [(*oil, 11)],  # never fits
    }
    asked = make([(r, r, items) for r, items in wanted.items()], f"request_id long, order_id long, parts {line}")
    got = orders.add_parts_in_sequence(asked, parts, 1)
    assert rows(got.lines.select("request_id").distinct()) == [(1,), (3,), (5,)]
    assert rows(got.rejects) == [(2, "insufficient_stock"), (4, "insufficient_stock"), (6, "insufficient_stock")]


def test_adding_services(make, services):
    line = "array<struct<service_name:string,quantity:int>>"
    asked = make(
        [(1, 1, 3, [("oil change", 1), ("body paint", 1)]), (2, 1, None, [("oil change", 1), ("nothing", 1)])],
        f"request_id long, order_id long, mechanic_id long, services {line}",
    )
    got = orders.add_services_to_orders(asked, services)
    assert rows(got.lines, "order_id", "service_id", "mechanic_id", "quantity") == [(1, 1, 3, 1), (1, 2, 3, 1)]
    assert rows(got.rejects) == [(2, "service_not_found")]


def test_changing_dates_writes_null_and_the_last_change(make):
    stored = make([(1, None), (2, None), (3, None)], "order_id long, order_date date").selectExpr(
        "order_id", "date'2025-01-01' AS order_date"
    )
    changes = make([(1, 1, "2025-05-21"), (1, 2, "2025-05-22"), (2, 1, None)], "order_id long, seq long, d string")
    after = orders.update_order_dates(stored, changes.selectExpr("order_id", "seq", "cast(d AS date) AS order_date"))
    assert [(r[0], str(r[1])) for r in rows(after)] == [(1, "2025-05-22"), (2, "None"), (3, "2025-01-01")]
