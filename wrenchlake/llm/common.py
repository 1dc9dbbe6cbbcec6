"""Helpers shared by the operators: Arrow passes, checked broadcasts, numbering, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import ctypes
import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.session import new_shared_folder, stage

# Functions of this package travel inside the job, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules["wrenchlake"])

#: What counts as a word everywhere here; `bytes.split()` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when a count has shown it to have at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows that a Python task turns into objects at a time.
SLICE_ROWS = 1000
#: Keys called hot: there are at most so many, as each holds at least that share of the rows.
HOT_KEYS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_pass(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, object]], schema: str, memory: str | None = None
) -> DataFrame:
    """Map every Arrow batch to columns. `rows` returns one list or array per output column, and may use the worker's `memory`."""
    types = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_memory(memory)
        for batch in sliced(batches):
            out = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


def stage_text(df: DataFrame) -> DataFrame:
    """`stage` for tables of texts, which are worth stronger compression."""
    path = new_shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_memory(name: str) -> dict:
    """A dictionary that the Python worker keeps over its tasks, until it turns to a pass that uses another one, or none."""
    drop_worker_memory(name)
    return sys.modules.setdefault(f"wrenchlake_memory_{name}", types.ModuleType(name)).__dict__


def drop_worker_memory(but: str | None = None) -> None:
    """Let go of what earlier operators have kept in this Python worker, which outlives them; `but` names what stays."""
    held = [m for m in sys.modules if m.startswith("wrenchlake_memory_") and m != f"wrenchlake_memory_{but}"]
    for name in held:
        del sys.modules[name]
    if held:
        pa.default_memory_pool().release_unused()
        # What lies free between other allocations goes back too, where the C library can do that.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects are made for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of one key after another, from batches that are sorted by the keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(c[lo].as_py() for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a staged table is short enough to be broadcast; stops counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table with the hint to broadcast it if a count allows that, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def join_counted(left: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join with one row per key; `count` in `keyed` is the key's number of rows on the left.

    Keys with at least `total / HOT_KEYS` rows (1000 at least) are broadcast: there cannot be more than
    HOT_KEYS of them. The other keys are short, so the shuffled join has no large one. Both tables should be staged.
    """
    floor = max(1000, total // HOT_KEYS)
    added = [c for c in keyed.columns if c not in (key, count)]
    right = keyed.select(F.col(key).alias("__key"), count, *added)
    hot = F.broadcast(right.filter(F.col(count) >= floor).drop(count))
    cold = right.filter(F.col(count) < floor).drop(count)
    match = F.col(key).eqNullSafe(F.col("__key"))
    names = [*left.columns, *added]
    return (
        left.join(hot, match, "inner")
        .select(*names)
        .unionByName(left.join(hot, match, "left_anti").join(cold, match, "left").select(*names))
    )


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 0 along the order, without bringing them into one task.

    Range partitions are written, counted and numbered apart, then shifted by the counts before them.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        "__part",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # One row per range partition, so their number is that of the tasks, not of the rows.
    return (
        ranged.withColumn("__own", own)
        .join(F.broadcast(before), "__part")
        .withColumn(name, F.col("__before") + F.col("__own") - 1)
        .drop("__part", "__own", "__before")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of long node ids: (node, root), a row for each node of an edge.

    Each round every node points to the one of its closed neighbourhood with the least hash (salted by the
    round), and edges move to what their ends point to; a constant share of the nodes goes in each round, however long the
    chains are. Then the pointers are followed back. The root is an arbitrary node of the component.
    """
    live = stage(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    pointers: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        point = stage(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(F.struct(F.xxhash64("b", F.lit(len(pointers))).alias("h"), F.col("b").alias("v"))).alias("best"))
            .select(
                "node",
                F.least(
                    F.struct(F.xxhash64("node", F.lit(len(pointers))).alias("h"), F.col("node").alias("v")), "best"
                )["v"].alias("root"),
            )
        )
        pointers.append(point)
        to_a = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stage(
            live.join(to_a, "a")
            .join(to_b, "b")
            .filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = pointers[-1]
    for point in reversed(pointers[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("__top"))
        found = point.join(later, "root", "left").select("node", F.coalesce("__top", "root").alias("root"))
    return stage(found)
