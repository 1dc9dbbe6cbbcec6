"""Claims, saves with rules, repeated raises and placed orders against plain sequential code."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from tests.conftest import rows
from wrenchlake.operators import cars, claims, mechanics, orders, rejects, saving
from wrenchlake.session import folders_made, stage

CARS = "car_id long, owner_id long, model string, color string, license_plate string"
EDITS = "op string, seq long, " + CARS
PEOPLE = "mechanic_id long, full_name string, phone_number string, qualification string, salary decimal(10,2), experience int"
PARTS = "part_id long, part_name string, manufacturer string, price decimal(10,2), stock_quantity int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_equal_a_sequential_fold(seed, make):
    rng = random.Random(seed)
    asked = [(k, rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(12)])) for k in range(60)]
    got = {r.request_id: r.lost for r in claims.claim(make(asked, "request_id long, plate string, number long"), ["plate", "number"]).collect()}
    plates, numbers, want = set(), set(), {}
    for request, plate, number in asked:
        want[request] = "plate" if plate in plates else "number" if number in numbers else None
        if want[request] is None:
            plates |= {plate} - {None}
            numbers |= {number} - {None}
    assert got == want
    assert claims.claim(make([], "request_id long, plate string, number long"), ["plate", "number"]).count() == 0


def test_given_car_ids(make):
    clients = make([(1, "A", "+70000000001"), (2, "B", None)], "client_id long, full_name string, phone string")
    garage = make([(10, 1, "m", "c", "P10"), (11, 2, "m", "c", None)], CARS)
    asked = make(
        [
            (1, "+70000000001", "m", "c", "P10", 50),
            (2, "+70000000001", "m", "c", "N1", 10),
            (3, "+70000000001", "m", "c", "N1", 50),
            (4, "+70000000001", "m", "c", "N1", 51),
            (5, "+70000000001", "m", "c", "N2", 50),
            (6, "+70000000001", "m", "c", None, 52),
            (7, "+70000000001", "m", "c", "N3", None),
            (8, None, "m", "c", "N4", 60),
            (9, "+70000000001", "m", "c", "N2", None),
        ],
        "request_id long, phone string, model string, color string, license_plate string, car_id long",
    )
    got = cars.register_cars(asked, clients, garage)
    assert rows(got.added, "car_id", "license_plate") == [(50, "N1"), (52, None), (53, "N3"), (54, "N2")]
    assert rows(got.rejects) == [
        (1, "duplicate_plate"), (2, "duplicate_key"), (4, "duplicate_plate"), (5, "duplicate_key"), (8, "client_not_found"),
    ]
    assert rows(cars.client_cars(got, clients), "client_id", "car_id") == [(1, 10), (1, 50), (1, 52), (1, 53), (1, 54)]


def save_in_sequence(stored, edits):
    """The cars after the edits, or the edit that the save fails at."""
    held = {r[0]: r for r in stored}
    for op, seq, *row in sorted(edits, key=lambda e: e[1]):
        car, plate = row[0], row[4]
        if (op == "insert") == (car in held):
            return None, (seq, car, "edit_conflict")
        if op == "insert" and plate is not None and any(r[4] == plate for r in held.values()):
            return None, (seq, car, "duplicate_plate")
        if op == "delete":
            del held[car]
        else:
            held[car] = tuple(row)
    return sorted(held.values(), key=repr), None


@pytest.mark.parametrize("hot_rows", [2, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_saved_cars_equal_a_sequential_save(seed, hot_rows, make):
    rng = random.Random(seed)
    stored = [(k, 1, "m", "c", rng.choice([None, f"P{k}"])) for k in range(4)]
    table = make(stored, CARS)
    for length in (3, 6):
        edits = []
        for seq in range(length):
            car = rng.randrange(7)
            held, _ = save_in_sequence(stored, edits)
            there = held is not None and any(r[0] == car for r in held)
            op = rng.choice(["update", "delete"]) if there else "insert"
            edits.append((op, seq, car, seq, "m", "c", rng.choice([None, "P1", "P2", f"N{seq}"])))
        got = saving.save_cars(table, make(edits, EDITS), hot_rows)
        want, refused = save_in_sequence(stored, edits)
        assert rows(got.refused) == ([] if refused is None else [refused])
        assert rows(got.table) == sorted(stored if refused else want, key=repr)


def test_a_plate_is_free_after_its_bearer_gave_it_up(make):
    table = make([(1, 1, "m", "c", "A"), (2, 1, "m", "c", "B")], CARS)
    good = [("update", 1, 1, 1, "m", "c", "X"), ("insert", 2, 3, 1, "m", "c", "A"), ("delete", 3, 2, 1, "m", "c", "B"), ("insert", 4, 2, 1, "m", "c", "B")]
    saved = saving.save_cars(table, make(good, EDITS))
    assert rows(saved.table, "car_id", "license_plate") == [(1, "X"), (2, "B"), (3, "A")] and saved.refused.count() == 0
    bad = [*good, ("insert", 5, 9, 1, "m", "c", "X"), ("insert", 6, 10, 1, "m", "c", "B")]
    saved = saving.save_cars(table, make(bad, EDITS))
    assert rows(saved.refused) == [(5, 9, "duplicate_plate")] and rows(saved.table, "car_id") == [(1,), (2,)]
    assert rows(saving.save_cars(table, make([], EDITS)).table, "car_id") == [(1,), (2,)]


def test_saved_mechanics(make):
    people = make([(k, f"m{k}", "p", "q", Decimal(100), 5) for k in (1, 2, 3)], PEOPLE)
    lines = make([(1, 1, 1, 1), (2, 1, 2, 1), (3, 1, None, 1)], "order_id long, service_id long, mechanic_id long, quantity int")
    head = "op string, seq long, " + PEOPLE
    edits = [
        ("update", 1, 2, "m2", "p", "q", Decimal(200), 6), ("update", 2, 2, "n2", "p", "q", Decimal(300), 6), ("update", 3, 3, "m3", "p", "q", Decimal(50), None),
        ("delete", 4, 1, "m1", "p", "q", Decimal(100), 5), ("insert", 5, 7, "m7", "p", "q", Decimal(10), 1), ("update", 6, 7, "m7", "p", "q", Decimal(10), 2),
    ]
    saved = saving.save_mechanics(people, make(edits, head), lines, "s")
    assert rows(saved.table, "mechanic_id", "full_name", "salary", "experience") == [
        (2, "n2", Decimal("300.00"), 6), (3, "m3", Decimal("10050.00"), None), (7, "m7", Decimal("10010.00"), 2),
    ]
    got = {r.order_id: r.mechanic_id for r in saved.service_lines.collect()}
    assert got[2] == 2 and got[1] == got[3] and got[1] in (2, 3, 7)
    saved = saving.save_mechanics(people, make([*edits, ("delete", 9, 1, "m1", "p", "q", None, None)], head), lines, "s")
    assert rows(saved.refused) == [(9, 1, "edit_conflict")]
    assert rows(saved.table) == rows(people) and rows(saved.service_lines) == rows(lines)


def test_saved_parts(make):
    parts = make([(1, "a", "m", Decimal(1), 5), (2, "b", "m", Decimal(1), 5)], PARTS)
    usage = make([(9, 1, 1)], "order_id long, part_id long, quantity int")
    head = "op string, seq long, " + PARTS
    good = [("delete", 1, 2, None, None, None, None), ("update", 2, 1, "a", "m", Decimal(7), 5)]
    saved = saving.save_parts(parts, make(good, head), usage)
    assert rows(saved.table, "part_id", "price") == [(1, Decimal("7.00"))]
    saved = saving.save_parts(parts, make([*good, ("delete", 3, 1, None, None, None, None)], head), usage)
    assert rows(saved.refused) == [(3, 1, "part_in_use")] and saved.table.count() == 2


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_repeated_updates_raise_once_per_change(hot_rows, make):
    people = make([(k, "m", "p", "q", Decimal(0), 5) for k in (1, 2, 3)], PEOPLE)
    updates = [(1, 1, 5), (1, 2, 6), (1, 3, 6), (1, 4, None), (1, 5, None), (1, 6, 5), (2, 9, 5), (404, 1, 1)]
    got = mechanics.raise_for_experience(people, make(updates, "mechanic_id long, seq long, experience int"), hot_rows)
    assert rows(got, "mechanic_id", "salary", "experience") == [(1, Decimal("30000.00"), 5), (2, Decimal("0.00"), 5), (3, Decimal("0.00"), 5)]


def test_placed_orders_lower_the_stock_one_after_another(make):
    parts = make([(1, "a", "m", Decimal(10), 10), (2, "b", "m", Decimal(10), None), (3, "c", "m", Decimal(10), 3)], PARTS)
    services = make([(1, "s", Decimal(5))], "service_id long, service_name string, price decimal(10,2)")
    stored = make([(70,)], "order_id long")
    asked = make(
        [
            (1, [1], [6], [1], [1]), (2, [1, 3], [6, 1], [], []), (3, [1], [4], [], []), (4, [3, 3], [2, 2], [], []),
            (5, [2], [1000], None, None), (6, [3], [3], [], []), (7, [9], [1], [], []), (8, [1], [1], [], []), (9, [], [], [1], [2]),
        ],
        "request_id long, part_ids array<long>, part_qty array<int>, service_ids array<long>, service_qty array<int>",
    ).selectExpr("*", "1L client_id", "1L car_id", "1L workplace_id", "date'2001-01-01' order_date", "1L payment_type_id", "4L mechanic_id")
    got = orders.place_orders(asked, stored, parts, services)
    assert rows(got.rejects) == [(2, "insufficient_stock"), (4, "insufficient_stock"), (7, "part_not_found"), (8, "insufficient_stock")]
    assert rows(got.parts, "part_id", "stock_quantity") == [(1, 0), (2, None), (3, 0)]
    assert rows(got.part_lines) == [(71, 1, 6), (72, 1, 4), (73, 2, 1000), (74, 3, 3)]
    assert rows(got.orders, "order_id", "total_amount") == [
        (71, Decimal("65.00")), (72, Decimal("40.00")), (73, Decimal("10000.00")), (74, Decimal("30.00")), (75, Decimal("10.00")),
    ]


def test_reject_ledger(spark, make):
    one, none = make([(1, "bad"), (2, "bad"), (3, "worse")], "request_id long, reason string"), make([], "reason string")
    ledger = rejects.write_ledger(spark, {"one": one, "none": none})
    assert rows(rejects.count_reasons(ledger), "source", "reason", "n") == [("one", "bad", 2), ("one", "worse", 1)]


def test_reject_ledger_plans_a_source_when_its_turn_comes_and_keeps_sources_apart(spark, make):
    seen = []

    def source(k):
        seen.append(k)
        return stage(make([(i, f"r{i % 2}") for i in range(k)], "request_id long, reason string"))

    given = {f"s {k}/": lambda k=k: source(k) for k in range(12)}
    before = len(folders_made())
    got = rejects.count_reasons(rejects.write_ledger(spark, given))
    want = [(f"s {k}/", f"r{r}", len(range(r, k, 2))) for k in range(12) for r in range(2) if k > r]
    assert rows(got, "source", "reason", "n") == sorted(want, key=repr) and sorted(seen) == list(range(12))
    # Threads that make folders at the same time each get their own.
    assert len(set(folders_made()[before:])) == 13


def test_a_ledger_source_that_fails_fails_the_ledger(spark, make):
    good = make([(1, "bad")], "request_id long, reason string")
    with pytest.raises(ZeroDivisionError):
        rejects.write_ledger(spark, {"good": good, "broken": lambda: 1 // 0})
