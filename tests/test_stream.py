"""The streamed stock rule leaves what the batch rule leaves, however the lines fall into files."""

from __future__ import annotations

from tests.conftest import rows
from wrenchlake.operators import stock
from wrenchlake.sources import requests
from wrenchlake.sources.starmap import parts
from wrenchlake.streaming import stock_stream

import pytest


@pytest.mark.parametrize("files", [1, 3])
def test_batches_do_not_change_the_stock(files, spark, small, tmp_path):
    lines = requests.sale_lines(spark, small)
    # Order ids are split into consecutive ranges, one file each, written in order.
    top = lines.agg({"order_id": "max"}).first()[0] + 1
    for i in range(files):
        low, high = top * i // files, top * (i + 1) // files
        lines.filter(f"order_id >= {low} AND order_id < {high}").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"part={i}")
        )
    source = (
        spark.readStream.schema(lines.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(tmp_path / "in"))
    )
    ledger = str(tmp_path / "ledger")
    query = stock_stream.sell_stream(
        source, lambda s: parts(s, small), requests.SALE_ARRIVAL, ledger, str(tmp_path / "progress")
    )
    query.awaitTermination()
    done = stock_stream.finished_batches(spark, ledger)
    assert done == files
    got = stock_stream.stock_left(spark, parts(spark, small), ledger, done)
    want = stock.sell_one_by_one(parts(spark, small), lines, requests.SALE_ARRIVAL).parts
    assert rows(got, "part_id", "stock_quantity") == rows(want, "part_id", "stock_quantity")


def test_restart_without_and_with_new_files(spark, make, tmp_path):
    schema = "order_id long, line_no long, part_id long, mechanic_id long, quantity long, amount int, ship_date date"
    stocked = make([(1, 10), (2, 5)], "part_id long, stock_quantity int")
    ledger, progress = str(tmp_path / "ledger"), str(tmp_path / "progress")

    def bring(i, quantity):
        line = make([(i, 1, 1, 1, quantity, 1, None)], schema)
        line.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))

    def run():
        source = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        stock_stream.sell_stream(source, lambda s: stocked, requests.SALE_ARRIVAL, ledger, progress).awaitTermination()
        done = stock_stream.finished_batches(spark, ledger)
        return done, rows(stock_stream.stock_left(spark, stocked, ledger, done))

    assert stock_stream.finished_batches(spark, ledger) == 0
    bring(1, 3)
    assert run() == (1, [(1, 7), (2, 5)])
    assert run() == (1, [(1, 7), (2, 5)])
    bring(2, 6)
    bring(3, 2)  # does not fit any more
    bring(4, 1)
    assert run() == (4, [(1, 0), (2, 5)])
    assert sorted(x.name for x in (tmp_path / "ledger").iterdir()) == ["batch_id=2", "batch_id=3"]
