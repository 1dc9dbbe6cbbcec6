"""One ledger for everything that was refused."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.session import new_shared_folder

#: Sources that are worked on side by side, so that the short rounds of one leave no core idle.
SOURCES_AT_ONCE = 8


def write_ledger(spark: SparkSession, refusals: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """Write the reasons of all sources as one table with a folder per source, and read it back.

    A source appends to its own folder, so more can be added later without touching the others. Sources know nothing of each other and
    are written side by side, in the order given; one that is a function is planned, with the jobs this takes, when its turn comes.
    """
    path = new_shared_folder(spark)

    def write(name: str) -> None:
        given = refusals[name]
        refused = given() if callable(given) else given
        refused.select(F.col("reason").cast("string")).write.parquet(f"{path}/source={quote(name, safe='')}")

    with ThreadPoolExecutor(SOURCES_AT_ONCE) as pool:
        # Wrapped one by one: each job has local properties of its own, copied from this thread's.
        running = [pool.submit(inheritable_thread_target(spark)(write), name) for name in refusals]
    for one in running:
        one.result()
    return spark.read.schema("reason string, source string").parquet(path)


def count_reasons(ledger: DataFrame) -> DataFrame:
    """(source, reason, n): refused rows by source and reason."""
    return ledger.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
