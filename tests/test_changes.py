from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wrenchlake.functions import text
from wrenchlake.operators import cars, checks, contacts, edits, mechanics

CLIENTS = "client_id long, full_name string, phone string"
CARS = "car_id long, owner_id long, model string, color string, license_plate string"
MECHANICS = (
    "mechanic_id long, full_name string, phone_number string, qualification string, salary decimal(10,2), experience int"
)


@pytest.fixture
def people(make):
    return make([(1, "Ann", "+70000000001"), (2, "Bob", "+70000000002"), (3, "Bob", "+70000000003")], CLIENTS)


@pytest.fixture
def garage(make):
    return make([(10, 1, "Kia", "white", "A1"), (11, 2, "Lada", "red", None)], CARS)


@pytest.fixture
def crew(make):
    return make(
        [
            (2, "Max", "+79990000002", "senior", Decimal("1000.00"), 5),
            (3, "Eve", "+79990000003", "junior", Decimal("500.00"), None),
            (103, "Old", "+79990000103", "junior", Decimal("400.00"), 1),
        ],
        MECHANICS,
    )


def test_phone_forms(make):
    typed = make([("+7 (913) 136-41-83",), ("+7 (913) 136-41-8",), ("",), (None,)], "typed_phone string")
    got = [r.phone for r in contacts.normalize_phones(typed).collect()]
    assert got == ["+79131364183", None, None, None]
    phones = make([("+79131364183",), ("+799912368",), ("+7913136418x",), (None,), ("+791313641830",)], "phone string")
    assert [r.valid for r in contacts.validate_phones(phones).collect()] == [True, False, False, False, False]


def test_like_keeps_wildcards_and_contains_does_not(make):
    names = make([("100% Max",), ("1000 Max",), ("max",)], "n string")
    assert rows(names.filter(text.like_anywhere(F.col("n"), " 100_ M "))) == [("100% Max",), ("1000 Max",)]
    assert rows(names.filter(text.contains_literally(F.col("n"), "100%"))) == [("100% Max",)]
    assert names.filter(text.like_anywhere(F.col("n"), "  ")).count() == 3
    assert names.filter(text.like_anywhere(F.col("n"), "Max")).count() == 2


def test_phone_updates(make, people):
    asked = make(
        [
            (1, 2, "+799912368"),
            (2, 1, "+70000000001"),
            (3, 1, "+70000000009"),
            (4, 2, "+70000000009"),
            (5, 99, "+70000000008"),
            (6, 2, "+70000000008"),
            (7, 1, "+70000000007"),
            (8, 3, None),
        ],
        "request_id long, client_id long, new_phone string",
    )
    got = contacts.update_phones(asked, people)
    status = {r.request_id: r.status for r in got.statuses.collect()}
    assert status == {
        1: "bad_phone",
        2: "phone_taken",
        3: "ok",
        4: "phone_taken",
        5: "ok",  # nobody to update, nothing taken
        6: "ok",
        7: "ok",
        8: "ok",
    }
    assert rows(got.table, "client_id", "phone") == [(1, "+70000000007"), (2, "+70000000008"), (3, None)]


def test_matching_contacts(make, people, crew):
    asked = make(
        [
            (1, "client", "+7 (000) 000-00-02"),
            (2, "mechanic", "+7 (000) 000-00-02"),
            (3, "mechanic", "+7 (999) 000-00-03"),
            (4, "client", "+7 (000)"),
        ],
        "request_id long, role string, typed_phone string",
    )
    got = contacts.match_contacts(asked, people, crew)
    assert rows(got, "request_id", "person_id", "status") == [
        (1, 2, "ok"),
        (2, None, "client_not_found"),
        (3, 3, "ok"),
        (4, None, "bad_phone"),
    ]


def test_appending_clients(make, people):
    asked = make(
        [(7, "New", "+7 (000) 000-00-77"), (5, "First", "+7 (000) 000-00-55"), (6, "", "+7 (000) 000-00-66"), (8, "X", "1")],
        "request_id long, full_name string, typed_phone string",
    )
    got = contacts.append_clients(asked, people, 1)
    assert rows(got.added) == [(4, "First", "+70000000055"), (5, "New", "+70000000077")]
    assert rows(got.rejects) == [(6, "missing_field"), (8, "bad_phone")]
    assert got.table.count() == 5
    empty = contacts.append_clients(asked, people.filter("client_id > 100"))
    assert rows(empty.added, "client_id") == [(1,), (2,)]


def test_registering_cars(make, people, garage):
    asked = make(
        [
            (1, "+70000000001", "Lanos", "pink", "M1"),
            (2, "+70000000002", "Lanos", "pink", "M1"),
            (3, "+70000000002", "Lanos", "pink", "A1"),
            (4, "+79999999999", "Lanos", "pink", "M2"),
            (5, "+70000000003", "Lanos", "pink", None),
            (6, "+70000000003", "Lanos", "pink", None),
            (7, "+70000000003", "Lanos", "pink", "M2"),
        ],
        "request_id long, phone string, model string, color string, license_plate string",
    )
    got = cars.register_cars(asked, people, garage)
    assert rows(got.added, "car_id", "owner_id", "license_plate") == [
        (12, 1, "M1"),
        (13, 3, None),
        (14, 3, None),
        (15, 3, "M2"),
    ]
    assert rows(got.rejects) == [(2, "duplicate_plate"), (3, "duplicate_plate"), (4, "client_not_found")]
    assert got.cars.count() == 6


ROWS = "request_id long, client_id long, full_name string, phone string, car_id long, model string, color string, license_plate string"


def one_by_one(clients, garage, inserted):
    """What inserting the rows one after another leaves behind."""
    clients, garage, refused = dict(clients), dict(garage), []
    for request, client, name, _, car, _, _, plate in sorted(inserted):
        if car not in garage and plate is not None and plate in garage.values():
            refused.append(request)
            continue
        clients.setdefault(client, name)
        garage.setdefault(car, plate)
    return clients, garage, refused


def row(request, client, car, plate):
    return (request, client, f"name {request}", "p", car, "m", "c", plate)


def test_view_inserts_equal_single_inserts(make, people, garage):
    inserted = [
        row(1, 444, 444, "X1"),
        row(2, 444, 445, "X1"),  # plate taken by row 1
        row(3, 445, 445, "X2"),  # row 2 left its car number free
        row(4, 446, 446, "X2"),  # plate taken by row 3
        row(5, 446, 446, "A1"),  # stored plate
        row(6, 446, 446, "X3"),
        row(7, 1, 10, "ZZ"),  # both stored
        row(8, 447, 10, "A1"),  # stored car, new client
        row(9, 448, 448, None),
        row(10, 449, 449, None),
    ]
    got = cars.insert_through_view(make(inserted, ROWS), people, garage)
    clients, stored, refused = one_by_one(
        {r.client_id: r.full_name for r in people.collect()},
        {r.car_id: r.license_plate for r in garage.collect()},
        inserted,
    )
    assert {r.client_id: r.full_name for r in got.clients.collect()} == clients
    assert {r.car_id: r.license_plate for r in got.cars.collect()} == stored
    assert sorted(r.request_id for r in got.rejects.collect()) == refused == [2, 4, 5]


def test_strict_view_insert_refuses_the_statement(make, people, garage):
    got = cars.insert_through_view(make([row(1, 444, 444, "X1"), row(2, 444, 445, "X1")], ROWS), people, garage, True)
    assert got.clients.count() == 3 and got.cars.count() == 2
    good = cars.insert_through_view(make([row(1, 444, 444, "X1")], ROWS), people, garage, True)
    assert good.clients.count() == 4 and good.cars.count() == 3 and good.rejects.count() == 0


def test_raise_for_experience(make, crew):
    updates = make([(2, 6), (3, None), (103, 0)], "mechanic_id long, experience int")
    got = mechanics.raise_for_experience(crew, updates)
    assert rows(got, "mechanic_id", "salary", "experience") == [
        (103, Decimal("10400.00"), 0),
        (2, Decimal("11000.00"), 6),
        (3, Decimal("500.00"), None),
    ]


def test_reassigning_mechanics(make, crew):
    lines = make(
        [(1, 1, 103, 1), (2, 1, 2, 1), (3, 1, None, 1)],
        "order_id long, service_id long, mechanic_id long, quantity int",
    )
    gone = make([(103,)], "mechanic_id long")
    got = {r.order_id: r.mechanic_id for r in mechanics.reassign_mechanics(lines, crew, gone, "s").collect()}
    assert got[2] == 2 and got[1] == got[3] and got[1] in (2, 3)
    everyone = crew.select("mechanic_id")
    got = {r.order_id: r.mechanic_id for r in mechanics.reassign_mechanics(lines, crew, everyone, "s").collect()}
    assert got == {1: None, 2: None, 3: None}
    nobody = make([(404,)], "mechanic_id long")
    got = {r.order_id: r.mechanic_id for r in mechanics.reassign_mechanics(lines, crew, nobody, "s").collect()}
    assert got == {1: 103, 2: 2, 3: None}


def test_edits(make, people):
    changes = make(
        [
            ("update", 1, 1, "Anna", "a"),
            ("update", 2, 1, "Anne", "b"),
            ("delete", 3, 2, None, None),
            ("insert", 4, 3, "clash", "c"),
            ("insert", 5, 50, "new", "d"),
            ("update", 6, 50, "newer", "e"),
            ("insert", 7, 51, "gone", "f"),
            ("delete", 8, 51, None, None),
            ("update", 9, 60, "nobody", "g"),
        ],
        "op string, seq long, client_id long, full_name string, phone string",
    )
    got = edits.apply_edits(people, changes, "client_id")
    assert rows(got.table) == [(1, "Anne", "b"), (3, "Bob", "+70000000003"), (50, "newer", "e")]
    assert rows(got.rejects) == [(4, 3, "edit_conflict"), (9, 60, "edit_conflict")]
    assert rows(edits.apply_edits(people, changes, "client_id", strict=True).table) == rows(people)
    fitting = changes.filter("seq NOT IN (4, 9)")
    assert edits.apply_edits(people, fitting, "client_id", strict=True).table.count() == 3


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_edits_that_do_not_fit_one_another(make, people, hot_rows):
    changes = make(
        [
            ("delete", 1, 1, None, None),
            ("update", 2, 1, "back", "a"),  # deleted before
            ("insert", 3, 50, "first", "b"),
            ("insert", 4, 50, "second", "c"),  # there already
            ("update", 5, 51, "early", "d"),  # not yet there
            ("insert", 6, 51, "late", "e"),
            ("insert", 7, 2, "clash", "f"),
            ("update", 8, 2, "fits", "g"),
            ("delete", 9, 52, None, None),
            ("insert", 10, 52, "new", "h"),
            ("delete", 11, 52, None, None),
        ],
        "op string, seq long, client_id long, full_name string, phone string",
    )
    got = edits.apply_edits(people, changes, "client_id", hot_rows=hot_rows)
    assert [r[:2] for r in rows(got.rejects)] == [(2, 1), (4, 50), (5, 51), (7, 2), (9, 52)]
    stays = [r for r in rows(people) if r[0] not in (1, 2)]
    want = [*stays, (2, "fits", "g"), (50, "first", "b"), (51, "late", "e")]
    assert rows(got.table) == sorted(want, key=repr)


def test_guarded_delete(make, crew):
    got = edits.guarded_delete(crew, make([(2,), (3,)], "mechanic_id long"), make([(3,)], "mechanic_id long"), "mechanic_id")
    assert rows(got.table, "mechanic_id") == [(103,), (3,)]
    assert rows(got.rejects) == [(3, "self_delete")]


def test_check_option(make):
    written = make([(1, 5, 5), (2, 5, 50), (3, 50, 5), (4, None, 5)], "id long, a int, b int")
    own, parent = F.col("a") < 10, F.col("b") < 10
    assert rows(checks.check_option(written, own, [parent], False).accepted, "id") == [(1,), (2,)]
    cascaded = checks.check_option(written, own, [parent], True)
    assert rows(cascaded.accepted, "id") == [(1,)]
    assert rows(cascaded.rejects, "id") == [(2,), (3,), (4,)]


def test_empty_batches_change_nothing(make, people, garage):
    got = cars.insert_through_view(make([], ROWS), people, garage)
    assert rows(got.clients) == rows(people) and rows(got.cars) == rows(garage)
    assert got.rejects.count() == 0
    asked = make([], "request_id long, phone string, model string, color string, license_plate string")
    registered = cars.register_cars(asked, people, garage)
    assert rows(registered.cars) == rows(garage) and registered.rejects.count() == 0
