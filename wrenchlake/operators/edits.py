"""Batches of edits to any keyed table: apply, guarded delete, merge."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.operators.ordered import HOT_ROWS, greatest_before


class Edited(NamedTuple):
    table: DataFrame
    rejects: DataFrame


def judge_edits(base: DataFrame, edits: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The edits with `fits`: whether their key is there, or not there, as they need it, when their turn comes by `seq`.

    After an insert, fitting or not, the key is there; after a delete it is not; an update changes nothing in that. So
    what an edit meets is told by the last insert or delete of its key before it, and by the stored table if there is none.
    """
    inserts = F.col("op") == "insert"
    turn = F.when(F.col("op") != "update", F.struct("seq", inserts.alias("there")))
    told = greatest_before(edits, [key], ["seq"], {"__turn": turn}, hot_rows)
    stored = base.select(key, F.lit(True).alias("__stored"))
    there = F.coalesce(F.col("__turn.there"), F.col("__stored"), F.lit(False))
    return told.join(stored, key, "left").select(*edits.columns, (inserts != there).alias("fits"))


def apply_edits(
    base: DataFrame, edits: DataFrame, key: str, strict: bool = False, hot_rows: int = HOT_ROWS
) -> Edited:
    """(op, seq, key, other columns) edits → the table afterwards, and the edits that do not fit.

    `op` is insert, update or delete, and the edits of a key come in the order of `seq`. Inserting a key that is
    there by then, or updating or deleting one that is not, is a conflict: that edit changes nothing and the others stand. In strict mode
    one conflict reverts the whole batch, as a failed save does.
    """
    values = [c for c in base.columns if c != key]
    judged = judge_edits(base, edits, key, hot_rows)
    # An aggregation, so a key that is edited very often is combined before the shuffle.
    net = judged.groupBy(key).agg(
        F.max(F.when(F.col("op") != "update", F.struct("seq", "op"))).alias("turn"),
        F.max(F.when(F.col("fits") & (F.col("op") != "delete"), F.struct("seq", *values))).alias("last"),
        F.lit(True).alias("edited"),
    )
    both = base.select(key, F.struct(*values).alias("old")).join(net, key, "full_outer")
    there = F.coalesce(F.col("turn.op") == "insert", F.col("old").isNotNull())
    new = F.when(F.col("last").isNotNull(), F.struct(*[F.col(f"last.{v}").alias(v) for v in values]))
    row = F.when(F.col("edited").isNull(), F.col("old")).when(there, F.coalesce(new, F.col("old")))
    conflicts = judged.filter(~F.col("fits"))
    if strict:
        revert = conflicts.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
        row = F.when(revert, F.col("old")).otherwise(row)
    after = both.withColumn("row", row).filter(F.col("row").isNotNull())
    return Edited(
        table=after.select(key, "row.*").select(*base.columns),
        rejects=conflicts.select("seq", key, F.lit(K.EDIT_CONFLICT).alias("reason")),
    )


def guarded_delete(base: DataFrame, doomed: DataFrame, protected: DataFrame, key: str) -> Edited:
    """Delete the listed keys except protected ones (the acting users' own rows)."""
    listed = doomed.select(key).distinct()
    guarded = protected.select(key).distinct()
    return Edited(
        table=base.join(listed.join(guarded, key, "left_anti"), key, "left_anti"),
        rejects=listed.join(guarded, key, "left_semi").select(key, F.lit(K.SELF_DELETE).alias("reason")),
    )


def merge_stock(parts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Merge deliveries: raise the stock of known parts and set their price, insert unknown parts.

    (part_id, part_name, manufacturer, price, quantity, seq). Deliveries of one part are
    summed first; name, maker and price come from the last one.
    """
    described = ["part_name", "manufacturer", "price"]
    source = deliveries.groupBy("part_id").agg(
        F.sum("quantity").alias("arrived"), F.max(F.struct("seq", *described)).alias("last")
    )
    stored = parts.select("part_id", F.struct(*[c for c in parts.columns if c != "part_id"]).alias("old"))
    merged = stored.join(source, "part_id", "full_outer")
    matched = F.col("old").isNotNull()
    arrived = F.coalesce("arrived", F.lit(0))
    price = F.when(F.col("last").isNotNull(), F.col("last.price")).otherwise(F.col("old.price"))
    return merged.select(
        "part_id",
        F.when(matched, F.col("old.part_name")).otherwise(F.col("last.part_name")).alias("part_name"),
        F.when(matched, F.col("old.manufacturer")).otherwise(F.col("last.manufacturer")).alias("manufacturer"),
        price.alias("price"),
        F.when(matched, F.col("old.stock_quantity") + arrived).otherwise(arrived).cast("int").alias("stock_quantity"),
    )
