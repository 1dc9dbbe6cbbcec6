"""Looking up catalogue rows for very many references, of which one may hold most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.operators.ordered import BROADCAST_KEYS, HOT_ROWS, split_hot


def join_references(
    rows: DataFrame,
    catalog: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_KEYS,
) -> DataFrame:
    """Left join with a catalogue that has one row per key.

    A catalogue that a count shows to be short is broadcast. A larger one is shuffled, and then rows of a key that more than `hot_rows` of them
    refer to would meet in one task: such keys are counted, and their few catalogue rows are broadcast.
    """
    keys = list(keys)
    if catalog.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(catalog), keys, "left")
    usual, hot = split_hot(rows, keys, hot_rows)
    if hot is None:
        return rows.join(catalog, keys, "left")
    # No more catalogue rows than there are hot keys, which are as few as split_hot's own count says.
    wanted = hot.select(*keys).distinct()
    few = catalog.join(wanted, keys, "left_semi")
    few = F.broadcast(few) if few.limit(broadcast_rows + 1).count() <= broadcast_rows else few
    return usual.join(catalog, keys, "left").unionByName(hot.join(few, keys, "left"))
