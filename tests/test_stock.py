from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wrenchlake.operators import contention, stock

PARTS = "part_id long, part_name string, manufacturer string, price decimal(10,2), stock_quantity int"
LINES = "order_id long, part_id long, quantity int"


def shelf(make, stocks):
    return make([(p, f"part {p}", "maker", None, s) for p, s in stocks.items()], PARTS)


def left_of(parts):
    return {r.part_id: r.stock_quantity for r in parts.collect()}


def test_statement_takes_all_or_nothing(make):
    parts = shelf(make, {1: 10, 2: 5, 3: None})
    good = make([(1, 1, 4), (2, 1, 6), (3, 2, 5), (4, 3, 99)], LINES)
    sold = stock.sell_as_statement(parts, good)
    assert left_of(sold.parts) == {1: 0, 2: 0, 3: None}
    assert sold.accepted.count() == 4 and sold.rejects.count() == 0
    over = make([(1, 1, 4), (2, 1, 7)], LINES)
    sold = stock.sell_as_statement(parts, over)
    assert left_of(sold.parts) == {1: 10, 2: 5, 3: None}
    assert rows(sold.rejects, "order_id", "reason") == [(1, "insufficient_stock"), (2, "insufficient_stock")]


def test_statement_of_no_lines(make):
    sold = stock.sell_as_statement(shelf(make, {1: 10}), make([], LINES))
    assert left_of(sold.parts) == {1: 10}


def test_prefix_refuses_everything_after_the_first_overdraw(make):
    parts = shelf(make, {1: 10})
    lines = make([(1, 1, 6), (2, 1, 5), (3, 1, 1), (4, 9, 3)], LINES)
    sold = stock.sell_by_prefix(parts, lines, ["order_id"], 1)
    assert left_of(sold.parts) == {1: 4}
    assert rows(sold.rejects, "order_id") == [(2,), (3,)]
    assert rows(sold.accepted, "order_id") == [(1,), (4,)]


def fold(stocks, requests):
    """One request after another; each takes all it wants or nothing."""
    stocks = dict(stocks)
    accepted = set()
    for request in sorted(requests):
        wanted = {}
        for part, quantity in requests[request]:
            wanted[part] = wanted.get(part, 0) + quantity
        if all(stocks.get(p) is None or q <= stocks[p] for p, q in wanted.items()):
            accepted.add(request)
            for p, q in wanted.items():
                if stocks.get(p) is not None:
                    stocks[p] -= q
    return stocks, accepted


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("hot_rows", "fold_lines"), [(3, 2), (1000, 40), (1000, 100_000)])
def test_whole_orders_equal_a_sequential_fold(seed, hot_rows, fold_lines, make):
    """In rounds, in groups of which some are too large for one task, and in one task."""
    rng = random.Random(seed)
    # Part 0 is on a third of all lines.
    stocks = {p: rng.choice([None, 5, 20, 60]) for p in range(1, 8)} | {0: 100}
    requests = {
        order: [
            (0 if rng.random() < 0.33 else rng.randrange(0, 9), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 4))
        ]
        for order in range(1, 120)
    }
    lines = make([(o, p, q) for o, items in requests.items() for p, q in items], LINES)
    sold = stock.sell_whole_orders(shelf(make, stocks), lines, hot_rows, fold_lines)
    want, accepted = fold(stocks, requests)
    assert left_of(sold.parts) == {p: want[p] for p in stocks}
    assert {r.order_id for r in sold.accepted.select("order_id").distinct().collect()} == accepted
    assert {r.order_id for r in sold.rejects.collect()} == set(requests) - accepted


def test_one_by_one_leaves_stock_to_smaller_lines(make):
    parts = shelf(make, {1: 10})
    lines = make([(1, 1, 6), (2, 1, 5), (3, 1, 4), (4, 1, 1)], LINES)
    sold = stock.sell_one_by_one(parts, lines, ["order_id"])
    assert left_of(sold.parts) == {1: 0}
    assert rows(sold.rejects, "order_id") == [(2,), (4,)]


def test_stock_is_conserved(make):
    parts = shelf(make, {1: 10, 2: 7})
    lines = make([(1, 1, 2), (1, 2, 3), (2, 1, 1)], LINES)
    sold = stock.sell_by_prefix(parts, lines, ["order_id"])
    back, kept = stock.return_lines(sold.parts, sold.accepted, make([(1, 1), (1, 2)], "order_id long, part_id long"))
    assert left_of(back) == {1: 9, 2: 7}
    assert rows(kept) == [(2, 1, 1)]


def test_returning_a_pair_takes_all_its_lines(make):
    parts = shelf(make, {1: 0, 2: None})
    lines = make([(76, 1, 2), (76, 1, 3), (77, 1, 5), (76, 2, 1)], LINES)
    pairs = make([(76, 1), (76, 1), (99, 1), (76, 2)], "order_id long, part_id long")
    back, kept = stock.return_lines(parts, lines, pairs)
    assert left_of(back) == {1: 5, 2: None}
    assert rows(kept) == [(77, 1, 5)]


def test_availability(make):
    parts = shelf(make, {3: 40, 4: None})
    asked = make(
        [(1, 3, 40), (2, 3, 50000), (3, 9, 1), (4, 4, 1), (5, 4, 0), (6, 3, None)],
        "request_id long, part_id long, quantity int",
    )
    answers = {r.request_id: r.available for r in stock.check_availability(asked, parts).collect()}
    assert answers == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_deleting_parts(make):
    parts = shelf(make, {1: 1, 34: 1, 35: 1})
    doomed = make([(34,), (35,), (99,)], "part_id long")
    usage = make([(34,), (34,), (99,)], "part_id long")
    done = stock.delete_parts(parts, doomed, usage)
    assert sorted(left_of(done.parts)) == [1, 34]
    assert rows(done.blocked) == [(34, "part_in_use")]
    strict = stock.delete_parts(parts, doomed, usage, strict=True)
    assert sorted(left_of(strict.parts)) == [1, 34, 35]
    free = stock.delete_parts(parts, doomed.filter(F.col("part_id") == 35), usage, strict=True)
    assert sorted(left_of(free.parts)) == [1, 34]


def test_no_lines_leave_the_stock_alone(make):
    parts = shelf(make, {1: 10, 2: None})
    none = make([], LINES)
    for sold in (
        stock.sell_one_by_one(parts, none, ["order_id"]),
        stock.sell_whole_orders(parts, none),
        stock.sell_by_prefix(parts, none, ["order_id"]),
    ):
        assert left_of(sold.parts) == {1: 10, 2: None}
        assert sold.accepted.count() == 0 and sold.rejects.count() == 0


def test_groups_of_parts_that_meet(make):
    pairs = [(r, p) for r in range(20) for p in (r, r + 1)] + [(100, 50), (100, 52), (101, 52), (102, 60)]
    groups = {r.part_id: r.group for r in contention.part_groups(make(pairs, "request_id long, part_id long")).collect()}
    assert len({groups[p] for p in range(21)}) == 1 and groups[50] == groups[52]
    assert len({groups[0], groups[50], groups[60]}) == 3
    assert contention.part_groups(make([], "request_id long, part_id long")).count() == 0


def test_requests_of_one_part_are_not_carried_through_the_rounds(make, monkeypatch):
    staged = []
    keep = contention.stage
    monkeypatch.setattr(contention, "stage", lambda df: staged.append(df.count()) or keep(df))
    pairs = [(r, r % 5) for r in range(300)] + [(1000, 0), (1000, 1)]
    groups = {r.part_id: r.group for r in contention.part_groups(make(pairs, "request_id long, part_id long")).collect()}
    assert groups[0] == groups[1] and len(set(groups.values())) == 4
    assert max(staged) <= 5


def test_refused_requests_are_those_that_are_not_accepted(make):
    parts = shelf(make, {1: 10, 2: 3})
    lines = make([(1, 1, 6), (2, 1, 5), (3, 1, 4), (3, 2, 1), (None, 1, 50), (4, 7, 9)], "request_id long, part_id long, quantity int")
    assert rows(contention.refused_requests(parts, lines)) == [(2,)]
    sold = stock.sell_whole_orders(parts, lines.withColumnRenamed("request_id", "order_id"))
    assert left_of(sold.parts) == {1: 0, 2: 2}
    assert rows(sold.accepted, "order_id") == [(1,), (3,), (3,), (4,)]


@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_single_sales_equal_a_sequential_fold(hot_rows, make):
    rng = random.Random(7)
    stocks = {1: 40, 2: 500, 3: None, 4: 0}
    lines = [(k, rng.choice([1, 1, 1, 2, 3, 4, 9]), rng.choice([1, 5, 20, None])) for k in range(120)]
    sold = stock.sell_one_by_one(shelf(make, stocks), make(lines, LINES).repartition(3), ["order_id"], hot_rows)
    left, kept = dict(stocks), []
    for line in lines:
        _, part, quantity = line
        if left.get(part) is None or quantity is None or quantity <= left[part]:
            kept.append(line)
            if left.get(part) is not None and quantity is not None:
                left[part] -= quantity
    assert left_of(sold.parts) == left
    assert rows(sold.accepted) == sorted(kept, key=repr)
    assert sold.rejects.count() == len(lines) - len(kept)


def test_parts_that_can_serve_all_are_not_looked_at(make):
    parts = shelf(make, {1: 10, 2: 3, 3: None})
    lines = make([(1, 1, 5), (2, 1, 5), (1, 2, 2), (2, 2, 2), (3, 3, 99), (4, 9, 1)], LINES)
    assert rows(contention.contested_lines(parts, lines), "order_id", "part_id") == [(1, 2), (2, 2)]


@pytest.mark.parametrize("how", ["prefix", "single", "whole"])
def test_lines_of_parts_with_enough_are_not_written(how, make, monkeypatch):
    parts = shelf(make, {1: 1000, 2: 3, 3: None})
    lines = make([(k, 1 + k % 4, 2) for k in range(40)], LINES)
    written, plain = [], contention.stage

    def counted(df):
        written.append(df.count())
        return plain(df)

    for module in (contention, stock):
        monkeypatch.setattr(module, "stage", counted)
    if how == "prefix":
        sold = stock.sell_by_prefix(parts, lines, ["order_id"])
    else:
        sold = stock.sell_one_by_one(parts, lines, ["order_id"]) if how == "single" else stock.sell_whole_orders(parts, lines)
    assert {k for (k,) in rows(sold.rejects, "order_id")} == set(range(5, 40, 4)) and sold.accepted.count() == 31
    # Ten of the forty lines ask for the one part that is short.
    assert max(written) <= 10


def test_prefix_with_lines_that_give_back_and_a_part_that_is_stored_twice(make):
    parts = make([(1, "a", "m", None, 5), (1, "a", "m", None, 50), (2, "b", "m", None, 5), (3, "c", "m", None, 9)], PARTS)
    lines = make([(1, 1, 4), (2, 1, 2), (1, 2, 6), (2, 2, -6), (3, 2, 1), (1, 3, 9), (2, 3, None), (1, None, 7), (1, 8, 7)], LINES)
    sold = stock.sell_by_prefix(parts, lines, ["order_id"])
    assert rows(sold.rejects, "order_id", "part_id", "running", "stock_quantity") == [(1, 2, 6, 5), (2, 1, 6, 5)]
    assert rows(sold.accepted) == sorted(
        [(1, 1, 4), (1, 1, 4), (2, 1, 2), (2, 2, -6), (3, 2, 1), (1, 3, 9), (2, 3, None), (1, None, 7), (1, 8, 7)], key=repr
    )
