"""Saving a batch of edits to a table that has rules of its own: all of it, or nothing.

A save fails as a whole at the first edit that does not fit or that a rule refuses, and everything stands as before. So every edit may be
judged as if all edits before it had gone through: if one is refused under that assumption, then the
first such edit is what the save fails at; if none is, the assumption holds. That makes the judgement of a sequence a matter of
running sums and neighbours instead of a loop over edits.

Each function returns the tables as they stand afterwards, and `refused`: no row, or the one edit (seq, key, reason) that the save
failed at. Edits are (op, seq, key, other columns); op is insert, update or delete, and seq is unique and gives their order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.operators.edits import judge_edits
from wrenchlake.operators.mechanics import reassign_mechanics
from wrenchlake.operators.ordered import HOT_ROWS, greatest_before, running_sums
from wrenchlake.session import stage


class Saved(NamedTuple):
    table: DataFrame
    refused: DataFrame


class SavedMechanics(NamedTuple):
    table: DataFrame
    service_lines: DataFrame
    refused: DataFrame


def _conflicts(base: DataFrame, edits: DataFrame, key: str, hot_rows: int) -> DataFrame:
    judged = judge_edits(base, edits, key, hot_rows)
    return judged.filter(~F.col("fits")).select("seq", F.col(key).alias("key"), F.lit(K.EDIT_CONFLICT).alias("reason"))


def _first_refused(refusals: DataFrame, key: str) -> DataFrame:
    """The refusal that comes first, staged: one row or none."""
    first = refusals.agg(F.min(F.struct("seq", "key", "reason")).alias("first")).filter(F.col("first").isNotNull())
    return stage(first.select("first.seq", F.col("first.key").alias(key), "first.reason"))


def _last_edits(edits: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, turn, row): the last edit of each key."""
    last = F.max(F.struct("seq", "op", F.struct(*values).alias("row"))).alias("last")
    return edits.groupBy(key).agg(last).select(key, F.col("last.op").alias("turn"), F.col("last.row").alias("row"))


def _table_after(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """The table after all edits went through."""
    values = [c for c in base.columns if c != key]
    last = _last_edits(edits, key, values)
    kept = base.join(last.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(last.filter(F.col("turn") != "delete").select(key, "row.*").select(*base.columns))


def _or_before(refused: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The table after the save, or before it if it was refused."""
    return before if not refused.isEmpty() else after


def save_parts(parts: DataFrame, edits: DataFrame, usage: DataFrame, hot_rows: int = HOT_ROWS) -> Saved:
    """Edits of parts. A part that an order line uses can't be deleted."""
    edits = stage(edits.select("op", "seq", *parts.columns))
    used = usage.select("part_id").distinct()
    blocked = edits.filter(F.col("op") == "delete").join(used, "part_id", "left_semi")
    refusals = _conflicts(parts, edits, "part_id", hot_rows).unionByName(
        blocked.select("seq", F.col("part_id").alias("key"), F.lit(K.PART_IN_USE).alias("reason"))
    )
    refused = _first_refused(refusals, "part_id")
    return Saved(_or_before(refused, parts, _table_after(parts, edits, "part_id")), refused)


def _plates_taken(cars: DataFrame, edits: DataFrame, hot_rows: int) -> DataFrame:
    """Inserts whose plate some car bears at that time.

    Every stored car and every edit gives its car a plate until the car's next edit. Per plate, cars that take it count
    one up and cars that give it up one down; an insert is refused if the sum before it is above zero.
    """
    own = edits.withColumn("plate", F.when(F.col("op") != "delete", F.col("license_plate")))
    turns = greatest_before(own, ["car_id"], ["seq"], {"__before": F.struct("seq", "plate")}, hot_rows)
    stored = cars.select("car_id", F.col("license_plate").alias("__stored"))
    turns = turns.join(stored, "car_id", "left")
    # Before its first edit a car bears the stored plate, which is given up then as any other.
    old = F.when(F.col("__before").isNotNull(), F.col("__before.plate")).otherwise(F.col("__stored"))
    insert = F.col("op") == "insert"
    taken = turns.filter(F.col("plate").isNotNull()).select(
        F.col("plate").alias("plate"), "seq", "car_id", F.lit(1).alias("n"), insert.alias("asks")
    )
    given_up = turns.filter(old.isNotNull()).select(
        old.alias("plate"), "seq", "car_id", F.lit(-1).alias("n"), F.lit(False).alias("asks")
    )
    # Only plates that some insert asks for matter.
    asked = taken.filter("asks").select("plate").distinct()
    borne = stored.filter(F.col("__stored").isNotNull()).select(
        F.col("__stored").alias("plate"),
        F.lit(None).cast(dict(edits.dtypes)["seq"]).alias("seq"),
        "car_id",
        F.lit(1).alias("n"),
        F.lit(False).alias("asks"),
    )
    events = taken.unionByName(given_up).unionByName(borne).join(asked, "plate", "left_semi")
    order = [F.col("seq").asc_nulls_first(), F.col("n"), F.col("car_id")]
    summed = running_sums(events, ["plate"], order, {"bearers": F.col("n").cast("long")}, hot_rows)
    return summed.filter(F.col("asks") & (F.col("bearers") > 1)).select("seq", F.col("car_id").alias("key"))


def save_cars(cars: DataFrame, edits: DataFrame, hot_rows: int = HOT_ROWS) -> Saved:
    """Edits of cars. A car with a plate that another car bears by then can't be inserted; updates are not held to that."""
    edits = stage(edits.select("op", "seq", *cars.columns))
    refusals = _conflicts(cars, edits, "car_id", hot_rows).unionByName(
        _plates_taken(cars, edits, hot_rows).withColumn("reason", F.lit(K.DUPLICATE_PLATE))
    )
    refused = _first_refused(refusals, "car_id")
    return Saved(_or_before(refused, cars, _table_after(cars, edits, "car_id")), refused)


def _raised(stored: Column) -> Column:
    """The salary an update leaves: what it wrote, and the raise if it changed the experience."""
    old = F.when(F.col("__before").isNotNull(), F.col("__before.experience")).otherwise(stored)
    changed = (F.col("op") == "update") & ~F.col("experience").eqNullSafe(old)
    return F.col("salary") + F.when(changed, F.lit(K.EXPERIENCE_RAISE)).otherwise(F.lit(0))


def save_mechanics(
    mechanics: DataFrame, edits: DataFrame, service_lines: DataFrame, seed: str, hot_rows: int = HOT_ROWS
) -> SavedMechanics:
    """Edits of mechanics. An update that changes the experience adds the raise to the salary it wrote; the lines of deleted
    mechanics, and lines without one, go to a mechanic who is there afterwards and was not deleted, drawn by the seed."""
    edits = stage(edits.select("op", "seq", *mechanics.columns))
    refused = _first_refused(_conflicts(mechanics, edits, "mechanic_id", hot_rows), "mechanic_id")
    if not refused.isEmpty():
        return SavedMechanics(mechanics, service_lines, refused)
    told = greatest_before(edits, ["mechanic_id"], ["seq"], {"__before": F.struct("seq", "experience")}, hot_rows)
    stored = mechanics.select("mechanic_id", F.col("experience").alias("__stored"))
    salary_type = mechanics.schema["salary"].dataType
    raised = told.join(stored, "mechanic_id", "left").withColumn("salary", _raised(F.col("__stored")).cast(salary_type))
    after = stage(_table_after(mechanics, raised.select("op", "seq", *mechanics.columns), "mechanic_id"))
    gone = edits.filter(F.col("op") == "delete").select("mechanic_id").distinct()
    there = after.unionByName(mechanics.join(gone, "mechanic_id", "left_semi").join(after, "mechanic_id", "left_anti"))
    return SavedMechanics(after, reassign_mechanics(service_lines, there, gone, seed), refused)
