"""Mechanic rules: the raise for experience, and handing over the work of deleted mechanics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake import constants as K
from wrenchlake.operators.ordered import HOT_ROWS, greatest_before


def raise_for_experience(mechanics: DataFrame, updates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Apply (mechanic_id, experience) updates; each that changes the experience, either way, raises the salary once.

    With a column `seq` a mechanic may be updated many times: updates come in that order, and an update is compared with the one
    before it. Without it, updates of one mechanic come in the order of the experience, null first.
    """
    told = updates if "seq" in updates.columns else updates.withColumn("seq", F.lit(0))
    told = told.select("mechanic_id", "experience", "seq")
    before = greatest_before(
        told, ["mechanic_id"], ["seq", "experience"], {"__before": F.struct("seq", "experience")}, hot_rows
    )
    first = F.col("__before").isNull()
    later_change = ~first & ~F.col("experience").eqNullSafe(F.col("__before.experience"))
    # An aggregation, so a mechanic with very many updates is combined before the shuffle.
    net = before.groupBy("mechanic_id").agg(
        F.max(F.when(first, F.struct("experience"))).alias("first"),
        F.max(F.struct("seq", "experience")).alias("last"),
        F.sum(later_change.cast("long")).alias("changes"),
    )
    updated = mechanics.join(net, "mechanic_id", "left")
    changed = F.col("last").isNotNull() & ~F.col("first.experience").eqNullSafe(F.col("experience"))
    raises = F.coalesce("changes", F.lit(0)) + changed.cast("long")
    salary_type = mechanics.schema["salary"].dataType
    salary = (F.col("salary") + raises * K.EXPERIENCE_RAISE).cast(salary_type)
    experience = F.when(F.col("last").isNotNull(), F.col("last.experience")).otherwise(F.col("experience"))
    new = {"salary": salary.alias("salary"), "experience": experience.alias("experience")}
    return updated.select(*[new.get(c, F.col(c)) for c in mechanics.columns])


def pick_mechanic(mechanics: DataFrame, seed: str) -> DataFrame:
    """One row, one column: a mechanic drawn by a seeded hash, or null if there is none."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.col("mechanic_id").cast("string")))
    return mechanics.agg(F.min_by("mechanic_id", draw).alias("mechanic_id"))


def reassign_mechanics(lines: DataFrame, mechanics: DataFrame, deleted: DataFrame, seed: str) -> DataFrame:
    """Service lines after the listed mechanics are deleted.

    Their lines, and lines that had no mechanic, all go to one remaining mechanic drawn by
    the seed; with none left they stay without one. Nothing changes if nobody is deleted.
    """
    gone = deleted.select("mechanic_id").distinct().join(mechanics.select("mechanic_id"), "mechanic_id", "left_semi")
    heir = pick_mechanic(mechanics.join(gone, "mechanic_id", "left_anti"), seed).scalar()
    any_gone = gone.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    # Lines without a mechanic need no look-up, and would all meet in one task of the join.
    marked = lines.filter(F.col("mechanic_id").isNotNull()).join(gone.withColumn("gone", F.lit(True)), "mechanic_id", "left")
    marked = marked.unionByName(lines.filter(F.col("mechanic_id").isNull()).withColumn("gone", F.lit(True)))
    mechanic = F.when(F.col("gone") & any_gone, heir).otherwise(F.col("mechanic_id"))
    return marked.withColumn("mechanic_id", mechanic).select(*lines.columns)
