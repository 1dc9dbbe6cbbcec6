"""Rows that claim keys nobody else may have, decided as if they came one after another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.session import stage


def claim(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(request_id, keys…) → (request_id, lost): the first of the keys that an earlier taken row holds, or null where the row is taken.

    Rows come in the order of request_id, which is unique; a refused row holds nothing. A null key claims nothing. Decided in rounds: a row that
    is the first open one for all its keys is taken, rows that share a key with a taken one are refused, the others
    wait for an earlier row whose fate is open. The first open row is always decided. With one key a single round does it.
    """
    work = stage(rows.select("request_id", *keys))
    all_taken, all_refused = [], []
    while True:
        judged = work
        for key in keys:
            first = work.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("request_id").alias(f"__first_{key}"))
            judged = _joined(judged, first, key)
        leads = [F.coalesce(F.col(f"__first_{k}") == F.col("request_id"), F.lit(True)) for k in keys]
        judged = stage(judged.withColumn("__taken", reduce(lambda a, b: a & b, leads)))
        taken = judged.filter("__taken").select("request_id", *keys)
        waiting = stage(_lost(judged.filter(~F.col("__taken")).select("request_id", *keys), taken, keys))
        all_taken.append(taken)
        all_refused.append(waiting.filter(F.col("lost").isNotNull()).select("request_id", *keys))
        work = waiting.filter(F.col("lost").isNull()).select("request_id", *keys)
        if work.isEmpty():
            break
    # What a refused row met first in its turn is known only now: later rounds may have taken its other keys before it.
    taken, refused = (reduce(DataFrame.unionByName, some) for some in (all_taken, all_refused))
    return taken.select("request_id", F.lit(None).cast("string").alias("lost")).unionByName(
        _lost(refused, taken, keys).select("request_id", "lost")
    )


def _joined(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Left join on a key that may be null; rows without it are not shuffled."""
    there = rows.filter(F.col(key).isNotNull()).join(keyed, key, "left")
    return there.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def _lost(rows: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with the first of their keys that an earlier taken row holds."""
    marked = rows
    for key in keys:
        held = taken.filter(F.col(key).isNotNull()).select(key, F.col("request_id").alias(f"__holder_{key}"))
        marked = _joined(marked, held, key)
    lost = F.coalesce(*[F.when(F.col(f"__holder_{k}") < F.col("request_id"), F.lit(k)) for k in keys])
    return marked.select("request_id", *keys, lost.alias("lost"))
