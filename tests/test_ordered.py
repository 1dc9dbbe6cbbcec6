"""Running sums and windows equal plain windows, whichever keys count as hot."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.oracle import connect, differences
from wrenchlake.operators import positions, stock
from wrenchlake.operators.ordered import greatest_before, hot_keys, row_numbers, running_sums
from wrenchlake.querybook.base import plain_types
from wrenchlake.querybook.book import find
from wrenchlake.sources import requests
from wrenchlake.sources.starmap import star_shop


@pytest.fixture
def skewed(make):
    # Key 0 holds most rows, one day of it most of those; null is a key of its own.
    data = [
        (None if i % 13 == 0 else (0 if i % 3 else i % 5), i, (i * 7) % 11 - 3, 4 if i % 4 else i % 6)
        for i in range(200)
    ]
    return make(data, "k long, id long, q long, day long")


@pytest.mark.parametrize("hot_rows", [1, 20, 10_000])
def test_running_sums_equal_plain_window(skewed, hot_rows):
    window = Window.partitionBy("k").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("k", "id", F.sum("q").over(window).alias("s"), F.count("*").over(window).alias("n"))
    got = running_sums(
        skewed,
        ["k"],
        ["day", "id"],
        {"s": F.col("q"), "n": F.lit(1).cast("long")},
        hot_rows,
    )
    assert rows(got, "k", "id", "s", "n") == rows(want)


def test_row_numbers_of_whole_table(skewed):
    got = row_numbers(skewed, [], ["day", "id"], "n")
    ordered = sorted((r.day, r.id, r.n) for r in got.collect())
    assert [r[2] for r in ordered] == list(range(1, 201))


@pytest.mark.parametrize("hot_rows", [1, 20, 10_000])
def test_greatest_before_equals_plain_window(skewed, hot_rows):
    window = Window.partitionBy("k").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("k", "id", F.max("q").over(window).alias("g"))
    got = greatest_before(skewed, ["k"], ["day", "id"], {"g": F.col("q")}, hot_rows)
    assert rows(got, "k", "id", "g") == rows(want)


def test_numbers_of_ids_spread_far_apart(make):
    ids = [(i * 2**62 // 300, i % 2) for i in range(300)]
    got = row_numbers(make(ids, "id long, x int").repartition(5), [], ["id"], "n")
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 301))


ARRIVAL = requests.SALE_ARRIVAL


def _tied_lines(make, columns):
    """Lines that are equal in all columns of the order but some."""
    usual = {"order_id": 1, "line_no": 1, "part_id": 1, "mechanic_id": 1, "quantity": 1, "amount": 5, "ship_date": "2001-01-05"}
    lines = []
    for k in range(12):
        other = {"quantity": 1 + k % 3, "amount": 5 - k % 2, "ship_date": f"2001-01-{20 - k:02d}"}
        lines.append(usual | {c: other.get(c, k % 4) for c in columns} | {"part_id": 1 + (k % 5 == 4)})
    return make(
        [tuple(x.values()) for x in lines],
        "order_id long, line_no long, part_id long, mechanic_id long, quantity long, amount int, ship_date string",
    )


@pytest.mark.parametrize("columns", [["quantity", "ship_date"], ["order_id", "quantity"], ["line_no", "mechanic_id", "amount"], ["amount", "ship_date"]])
def test_sales_with_ties_are_the_same_at_every_limit(make, columns):
    lines = _tied_lines(make, columns)
    stocked = make([(1, 9), (2, 2)], "part_id long, stock_quantity int")
    results = []
    for hot_rows in (1, 2, 1_000_000):
        prefix = stock.sell_by_prefix(stocked, lines, ARRIVAL, hot_rows)
        single = stock.sell_one_by_one(stocked, lines, ARRIVAL, hot_rows)
        results.append([rows(x) for x in (prefix.parts, prefix.accepted, single.parts, single.accepted)])
    assert results[0] == results[1] == results[2]
    # Brute force: each line in the plain order takes its stock if it fits.
    left, sold = {1: 9, 2: 2}, []
    for line in sorted(tuple(r) for r in lines.select(*ARRIVAL, "part_id").collect()):
        quantity = line[ARRIVAL.index("quantity")]
        if quantity <= left[line[-1]]:
            left[line[-1]] -= quantity
            sold.append(line)
    assert results[0][2] == sorted(left.items())


def test_hot_keys_are_bounded(skewed):
    assert hot_keys(skewed, ["k"], 50).count() <= 200 // 50


HOT = {
    "win_rank": lambda o: positions.with_rank(o, 3),
    "win_dense_rank": lambda o: positions.with_dense_rank(o, 3),
    "win_cume_dist": lambda o: positions.with_cume_dist(o, 3),
    "win_row_number": lambda o: positions.with_row_number(o, 3),
    "win_ntile": lambda o: positions.with_ntile(o, 4, 3),
    "win_lag": lambda o: positions.with_lag(o, "total_amount", 1, "lag", 3),
    "win_lead": lambda o: positions.with_lead(o, "order_date", 2, "lead", 3),
    "win_nth_value": lambda o: positions.with_nth_value(o, "total_amount", 2, "nth_value", 3),
}


@pytest.mark.parametrize("name", list(HOT))
def test_windows_with_hot_clients(name, spark, small):
    got = plain_types(HOT[name](star_shop(spark, small).orders))
    assert differences(got, connect(small), find(name).sql) is None


@pytest.mark.parametrize("hot_rows", [2, 40])
def test_prefix_sale_with_hot_parts(hot_rows, spark, small):
    sold = stock.sell_by_prefix(
        star_shop(spark, small).parts, requests.sale_lines(spark, small), requests.SALE_ARRIVAL, hot_rows
    )
    con = connect(small)
    assert differences(plain_types(sold.parts), con, find("stock_after_sales").sql) is None
    assert differences(plain_types(sold.rejects), con, find("stock_overdraw_lines").sql) is None
