"""Car registration: the plate rule, registering by phone, inserting through the joined view."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.functions.rules import first_reason, own_key
from wrenchlake.operators.claims import claim
from wrenchlake.operators.ordered import HOT_ROWS, row_numbers
from wrenchlake.session import stage


class Registered(NamedTuple):
    cars: DataFrame
    added: DataFrame
    rejects: DataFrame


class Upserted(NamedTuple):
    clients: DataFrame
    cars: DataFrame
    rejects: DataFrame


def judge_plates(rows: DataFrame, cars: DataFrame) -> DataFrame:
    """(request_id, license_plate, …) → the same with a reason where the plate exists.

    It exists if a stored car or an earlier accepted row has it, so of the rows that
    share a free plate the first by request_id passes. A null plate always passes.
    """
    stored = cars.select(F.col("license_plate").alias("__plate")).distinct().withColumn("stored", F.lit(True))
    marked = rows.withColumn("__plate", own_key("license_plate")).join(stored, "__plate", "left")
    first = (
        marked.filter(F.col("stored").isNull() & F.col("license_plate").isNotNull())
        .groupBy("__plate")
        .agg(F.min("request_id").alias("holder"))
    )
    reason = first_reason((F.col("stored") | (F.col("holder") < F.col("request_id")), K.DUPLICATE_PLATE))
    judged = marked.join(first, "__plate", "left").withColumn("reason", reason)
    return judged.select(*rows.columns, "reason")


def register_cars(requests: DataFrame, clients: DataFrame, cars: DataFrame, hot_rows: int = HOT_ROWS) -> Registered:
    """(request_id, phone, model, color, license_plate) → cars with the new ones.

    The owner is the client with that phone (the lowest id, if shared). A column `car_id` may name the new car's id: one that a stored car
    or an earlier accepted request has is refused, after the plate has been looked at. A request without an id gets the next one
    after the highest, in the order of request_id.
    """
    given = "car_id" in requests.columns
    asked = requests.withColumn("__phone", own_key("phone"))
    owners = clients.groupBy(F.col("phone").alias("__phone")).agg(F.min("client_id").alias("owner_id"))
    asked = asked.join(owners, "__phone", "left").drop("__phone")
    unknown = asked.filter(F.col("owner_id").isNull()).select(
        "request_id", F.lit(K.CLIENT_NOT_FOUND).alias("reason")
    )
    known = asked.filter(F.col("owner_id").isNotNull())
    # Judged once; the numbering and both outputs read what was staged.
    judged = stage(_judge_ids(known, cars) if given else judge_plates(known, cars))
    accepted = judged.filter(F.col("reason").isNull())
    columns = ["owner_id", "model", "color", "license_plate"]
    last_id = cars.agg(F.coalesce(F.max("car_id"), F.lit(0)).alias("last_id")).scalar()
    named = None
    if given:
        named = accepted.filter(F.col("car_id").isNotNull()).select("car_id", *columns)
        accepted = accepted.filter(F.col("car_id").isNull())
        last_id = F.greatest(last_id, named.agg(F.coalesce(F.max("car_id"), F.lit(0)).alias("last_id")).scalar())
    numbered = row_numbers(accepted, [], ["request_id"], "nth", hot_rows)
    added = numbered.select((last_id + F.col("nth")).alias("car_id"), *columns)
    if named is not None:
        added = named.unionByName(added)
    refused = judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return Registered(cars=cars.unionByName(added), added=added, rejects=unknown.unionByName(refused))


def _judge_ids(rows: DataFrame, cars: DataFrame) -> DataFrame:
    """The rows with a reason where the plate or the car's id exists; of competing rows the earliest wins, and a refused row holds neither."""
    names = rows.columns
    rows = stage(rows)
    plates = cars.filter(F.col("license_plate").isNotNull()).select(F.col("license_plate").alias("__p")).distinct()
    numbers = cars.select(F.col("car_id").alias("__c"))
    on_plate = own_key("license_plate") == F.col("__p")
    marked = rows.join(plates, on_plate, "left").withColumn("__plate_there", F.col("__p").isNotNull())
    with_id = marked.filter(F.col("car_id").isNotNull()).join(numbers, F.col("car_id") == F.col("__c"), "left")
    marked = with_id.unionByName(marked.filter(F.col("car_id").isNull()), allowMissingColumns=True)
    stored = first_reason((F.col("__plate_there"), K.DUPLICATE_PLATE), (F.col("__c").isNotNull(), K.DUPLICATE_KEY))
    marked = stage(marked.select(*names, stored.alias("reason")))
    claims = claim(marked.filter(F.col("reason").isNull()), ["license_plate", "car_id"])
    lost = F.when(F.col("lost") == "license_plate", K.DUPLICATE_PLATE).when(F.col("lost") == "car_id", K.DUPLICATE_KEY)
    return marked.join(claims, "request_id", "left").withColumn("reason", F.coalesce("reason", lost)).select(*names, "reason")


def client_cars(registered: Registered, clients: DataFrame) -> DataFrame:
    """(client_id, phone, car_id, model, color, license_plate): all cars, old and new, of the clients who have registered one."""
    owners = registered.added.select("owner_id").distinct()
    theirs = registered.cars.join(owners, "owner_id", "left_semi")
    return theirs.join(clients.select(F.col("client_id").alias("owner_id"), "phone"), "owner_id").select(
        F.col("owner_id").alias("client_id"), "phone", "car_id", "model", "color", "license_plate"
    )


def _new_cars(rows: DataFrame, refused: DataFrame | None) -> DataFrame:
    """Of the rows not refused, the first per car number."""
    left = rows if refused is None else rows.join(refused, "request_id", "left_anti")
    return left.groupBy("car_id").agg(F.min(F.struct("request_id", "license_plate")).alias("row")).select(
        "car_id", "row.*"
    )


def _plate_refusals(rows: DataFrame, cars: DataFrame) -> DataFrame | None:
    """Requests whose car is new but whose plate exists.

    A refused row leaves its car number to the next row that carries it, whose plate may
    clash in turn, so the search repeats until it finds nothing new. A refusal is
    never taken back: whoever holds the plate came earlier.
    """
    new = stage(rows.select("request_id", "car_id", "license_plate").join(cars.select("car_id"), "car_id", "left_anti"))
    refused: DataFrame | None = None
    while True:
        judged = judge_plates(_new_cars(new, refused), cars)
        found = stage(judged.filter(F.col("reason").isNotNull()).select("request_id", "car_id"))
        if found.isEmpty():
            return refused
        fresh = found.select("request_id")
        refused = fresh if refused is None else refused.unionByName(fresh)
        # Only a refused row that has a later row with its car number can change anything.
        later = new.join(found.withColumnRenamed("request_id", "refused_id"), "car_id").filter(
            F.col("request_id") > F.col("refused_id")
        )
        if later.isEmpty():
            return refused


def insert_through_view(rows: DataFrame, clients: DataFrame, cars: DataFrame, strict: bool = False) -> Upserted:
    """(request_id, client_id, full_name, phone, car_id, model, color, license_plate) → clients and cars.

    Clients and cars whose id is new are inserted, the first row of an id wins, stored rows
    stay as they are. A new car whose plate exists refuses its row, client included; in
    strict mode it refuses the whole batch, as one inserting statement would.
    """
    refused = _plate_refusals(rows, cars)
    rejects = (
        rows.select("request_id").limit(0)
        if refused is None
        else refused
    ).withColumn("reason", F.lit(K.DUPLICATE_PLATE))
    accepted = rows
    if refused is not None:
        accepted = rows.limit(0) if strict else rows.join(refused, "request_id", "left_anti")

    def first_new(key: str, stored: DataFrame, columns: list[str]) -> DataFrame:
        first = accepted.groupBy(key).agg(F.min(F.struct("request_id", *columns)).alias("row"))
        return first.join(stored.select(key), key, "left_anti").select(key, *[f"row.{c}" for c in columns])

    new_clients = first_new("client_id", clients, ["full_name", "phone"])
    new_cars = first_new(
        "car_id", cars, ["client_id", "model", "color", "license_plate"]
    ).withColumnRenamed("client_id", "owner_id")
    return Upserted(clients=clients.unionByName(new_clients), cars=cars.unionByName(new_cars), rejects=rejects)
