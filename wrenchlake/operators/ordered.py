"""Running sums and row numbers that survive one key holding most of the rows.

A plain window sends all rows of a key to one task. Here keys are counted first. Keys
of at most `hot_rows` rows use the plain window. The rows of larger keys are sorted into range
partitions of key and order, as many as there are shuffle partitions and of about equal size; each partition
is summed on its own and shifted by the totals of the partitions before it. A partition boundary
never separates rows that are equal in the order, and it is found from the rows themselves, so neither gaps in the ids
nor many rows of one day make a partition large. Without hot keys only the counting pass is left of this.

The range partitions are written before they are summed: a lost task then reads the same rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.session import stage

HOT_ROWS = 1_000_000
#: A list of hot keys is broadcast only if a count has shown it to be no longer than this.
BROADCAST_KEYS = 200_000

_GROUP = "__group"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows; there are at most rows / hot_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).drop("__n")


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the usual keys, and rows of the hot keys, or None if there are none."""
    hot = stage(hot_keys(df, keys, hot_rows).select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    number = hot.limit(BROADCAST_KEYS + 1).count()
    if not number:
        return df, None
    if number <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    return df.join(hot, condition, "left_anti"), df.join(hot, condition, "left_semi")


def _running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], how: str, hot_rows: int
) -> DataFrame:
    """`how` is "sum" (up to and including the row) or "max" (over the rows before it)."""
    last = Window.currentRow if how == "sum" else -1
    combined = F.sum if how == "sum" else F.max
    given = {n: F.coalesce(v, F.lit(0)) if how == "sum" else v for n, v in values.items()}
    kept = [c for c in df.columns if c not in values]

    def plain(rows: DataFrame, keys: Sequence[str] = keys) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return rows.select(*kept, *[combined(v).over(window).alias(n) for n, v in given.items()])

    def ranged(rows: DataFrame) -> DataFrame:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = stage(
            rows.select("*", *[v.alias(f"__v_{n}") for n, v in given.items()])
            .repartitionByRange(parts, *keys, *order)
            .withColumn("__part", F.spark_partition_id())
        )
        group = F.struct(*keys, "__part")
        totals = sorted_rows.groupBy(*keys, "__part").agg(*[combined(f"__v_{n}").alias(f"__t_{n}") for n in values])
        # A key has at most one row here per range partition.
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            group.alias(_GROUP), *[combined(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in values]
        )
        own = Window.partitionBy(_GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        local = sorted_rows.withColumn(_GROUP, group).select(
            *kept, _GROUP, *[combined(f"__v_{n}").over(own).alias(f"__l_{n}") for n in values]
        )

        def shifted(n: str) -> Column:
            if how == "sum":
                return F.col(f"__l_{n}") + F.coalesce(F.col(f"__o_{n}"), F.lit(0))
            return F.greatest(f"__l_{n}", f"__o_{n}")

        return local.join(offsets, _GROUP).select(*kept, *[shifted(n).alias(n) for n in values])

    if not keys:
        rows = stage(df)
        if rows.limit(hot_rows + 1).count() > hot_rows:
            return ranged(rows)
        # No more rows than a key may have: one task numbers them.
        return plain(rows.withColumn(_GROUP, F.lit(0)), [_GROUP])
    usual, hot = split_hot(df, keys, hot_rows)
    return plain(usual) if hot is None else plain(usual).unionByName(ranged(hot))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, per entry of `sums`, the sum over the rows of the key up to and including this one.

    Without keys the whole table is one hot key.
    """
    return _running(df, keys, order, sums, "sum", hot_rows)


def greatest_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add, per entry of `values`, the greatest over the rows of the key before this one; nulls do not count."""
    return _running(df, keys, order, values, "max", hot_rows)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its key; no keys number the whole table."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, hot_rows)
