"""The stock rule over a stream of sale lines.

Every micro-batch is sold by the same operator a batch job uses, against the stock left
by the batches before it. Each batch writes what was sold up to and including it, per part,
to a folder of its own. A batch that is run again after a failure reads the folder before
its own and overwrites its own; no batch reads more than one folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wrenchlake.operators.stock import sell_one_by_one
from wrenchlake.session import drop_folder

SOLD = T.StructType([T.StructField("part_id", T.LongType()), T.StructField("sold", T.LongType())])


def _batch_dir(ledger_dir: str, batch_id: int) -> str:
    return f"{ledger_dir}/batch_id={batch_id}"


def _sold_before(spark: SparkSession, ledger_dir: str, before: int) -> DataFrame:
    if before == 0:
        return spark.createDataFrame([], SOLD)
    return spark.read.schema(SOLD).parquet(_batch_dir(ledger_dir, before - 1))


def stock_left(spark: SparkSession, parts: DataFrame, ledger_dir: str, before: int) -> DataFrame:
    """Parts with the stock left by the batches numbered below `before`."""
    sold = _sold_before(spark, ledger_dir, before)
    left = (F.col("stock_quantity") - F.coalesce("sold", F.lit(0))).cast("int")
    return parts.join(sold, "part_id", "left").withColumn("stock_quantity", left).select(*parts.columns)


def sell_stream(
    lines: DataFrame,
    read_parts: Callable[[SparkSession], DataFrame],
    arrival: Sequence[str],
    ledger_dir: str,
    checkpoint_dir: str,
) -> StreamingQuery:
    """Sell a stream of lines one by one; each batch adds its folder to the ledger.

    Selling line by line gives the same stock however the lines fall into batches, if batches come in the order of
    arrival.
    """

    def sell(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = stock_left(spark, read_parts(spark), ledger_dir, batch_id)
        accepted = sell_one_by_one(parts, batch, arrival).accepted
        sold = accepted.select("part_id", F.col("quantity").cast("long").alias("sold"))
        upto = _sold_before(spark, ledger_dir, batch_id).unionByName(sold)
        upto.groupBy("part_id").agg(F.sum("sold").alias("sold")).write.mode("overwrite").parquet(
            _batch_dir(ledger_dir, batch_id)
        )
        if batch_id > 1:
            # A batch that runs again reads the one before it; nothing reads what lies further back.
            drop_folder(spark, _batch_dir(ledger_dir, batch_id - 2))

    return (
        lines.writeStream.foreachBatch(sell)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def finished_batches(spark: SparkSession, ledger_dir: str) -> int:
    """Number of batches whose ledger is written, over all runs of the query; a folder shows up only when it is whole."""
    try:
        files = spark.read.schema(SOLD).parquet(ledger_dir).inputFiles()
    except AnalysisException:
        return 0
    found = [int(m[1]) for f in files if (m := re.search(r"/batch_id=(\d+)/", f))]
    return max(found, default=-1) + 1
