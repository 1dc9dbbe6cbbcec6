"""Requests that compete for stock, decided as if they came one after another.

Most requests compete for nothing: a part that could serve all its requests refuses none of them, so only lines of parts that are asked
for more than they hold are looked at. Those lines fall into groups: parts that meet in a request belong together, and
groups know nothing of each other. A group is folded in order of arrival inside one task, which needs no more than the stock of the group's parts; groups lie
side by side in as many tasks as there are partitions. A group of more than `FOLD_LINES` lines is never brought into one task: its requests are decided
in rounds over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wrenchlake.operators.ordered import HOT_ROWS, row_numbers, running_sums, split_hot
from wrenchlake.session import stage

#: Lines that one task folds at most.
FOLD_LINES = 500_000


def _fits(stock: dict[int, int], part: int, quantity: int, stored: int) -> bool:
    return quantity <= stock.setdefault(part, stored)


def _fold_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by group and request → one verdict per request."""
    stock: dict[int, int] = {}
    group = request = None
    held: list[tuple[int, int]] = []
    fits = True
    ids: list = []
    verdicts: list[bool] = []

    def decide() -> None:
        if request is not None:
            if fits:
                for part, quantity in held:
                    stock[part] -= quantity
            ids.append(request)
            verdicts.append(fits)

    kind = None
    for batch in batches:
        kind = batch.schema.field("request_id").type
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("group", "request_id", "part_id", "quantity", "stock")]
        for g, r, part, quantity, stored in zip(*columns):
            if r != request:
                decide()
                held, fits, request = [], True, r
                if g != group:
                    stock, group = {}, g
            fits = _fits(stock, part, quantity, stored) and fits
            held.append((part, quantity))
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(verdicts, pa.bool_())], ["request_id", "accepted"])
        ids.clear()
        verdicts.clear()
    decide()
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(verdicts, pa.bool_())], ["request_id", "accepted"])


def part_groups(lines: DataFrame) -> DataFrame:
    """(part_id, group): parts that meet in a request, directly or through others, share a group.

    Each round every label goes over to the one of least hash, salted by the round, among those it meets in a request; a
    constant share of the labels goes in each, however long the chains are. The lines shrink to distinct pairs of request and label.
    """
    groups = stage(lines.select("part_id", F.col("part_id").alias("group")).distinct())
    met = lines.select("request_id", F.col("part_id").alias("group")).distinct()
    turn = 0
    while True:
        label = F.struct(F.xxhash64("group", F.lit(turn)).alias("h"), "group")
        best = met.groupBy("request_id").agg(F.min(label).alias("best"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        # A request of one label ties nothing together, now or later.
        met = stage(met.join(best, "request_id").select("request_id", "group", "best"))
        moved = stage(met.groupBy("group").agg(F.min("best").alias("best")).select("group", F.col("best.group").alias("to")))
        moved_ = moved.filter(F.col("group") != F.col("to"))
        if moved_.isEmpty():
            return groups

        def follow(df: DataFrame, moved_: DataFrame = moved_) -> DataFrame:
            return df.join(moved_, "group", "left").withColumn("group", F.coalesce("to", "group")).drop("to")

        groups, met, turn = stage(follow(groups)), stage(follow(met.drop("best")).distinct()), turn + 1


def contested_lines(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of parts that are asked for more than they hold, with the stored `stock`; an unknown stock or part serves all."""
    return lines.join(short_parts(parts, lines), "part_id")


def short_parts(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """(part_id, stock) of the parts that are asked for more than they hold."""
    asked = lines.groupBy("part_id").agg(F.sum("quantity").alias("asked"))
    stock = parts.select("part_id", F.col("stock_quantity").alias("stock"))
    return stock.join(asked, "part_id").filter(F.col("asked") > F.col("stock")).drop("asked")


def admit_requests(parts: DataFrame, lines: DataFrame, hot_rows: int = HOT_ROWS, fold_lines: int = FOLD_LINES) -> DataFrame:
    """(request_id, part_id, quantity) → (request_id, accepted), as if requests came one after another.

    Requests come in the order of request_id. Each takes all its parts or none, and a
    refused request uses no stock. All of them use the stock as given.
    """
    wanted = stage(_wanted(lines))
    work = stage(contested_lines(parts, wanted).filter(F.col("quantity").isNotNull()))
    verdicts = reduce(DataFrame.unionByName, _decide(work, hot_rows, fold_lines))
    return (
        wanted.select("request_id")
        .distinct()
        .join(verdicts, "request_id", "left")
        .withColumn("accepted", F.coalesce("accepted", F.lit(True)))
    )


def refused_requests(parts: DataFrame, lines: DataFrame, hot_rows: int = HOT_ROWS, fold_lines: int = FOLD_LINES) -> DataFrame:
    """(request_id) of the requests that admit_requests does not accept, without a row for each of the others."""
    # Only lines of short parts are summed by request; written, the short parts are a list of known size.
    short = stage(short_parts(parts, lines))
    wanted = _wanted(lines.join(short, "part_id", "left_semi"))
    work = stage(wanted.join(short, "part_id").filter(F.col("quantity").isNotNull()))
    verdicts = reduce(DataFrame.unionByName, _decide(work, hot_rows, fold_lines))
    # A null id equals no verdict's, so it is not refused.
    return verdicts.filter(~F.col("accepted") & F.col("request_id").isNotNull()).select("request_id")


def _wanted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("request_id", "part_id").agg(F.sum("quantity").cast("long").alias("quantity"))


def _decide(work: DataFrame, hot_rows: int, fold_lines: int) -> list[DataFrame]:
    """Verdicts of the requests in the staged work."""
    schema = work.select("request_id").withColumn("accepted", F.lit(True)).schema

    def folded(rows: DataFrame) -> DataFrame:
        return stage(rows.select("group", "request_id", "part_id", "quantity", "stock").mapInArrow(_fold_groups, schema))

    if work.limit(fold_lines + 1).count() <= fold_lines:
        # All of it is no more than a group may be.
        return [folded(work.withColumn("group", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("request_id"))]
    grouped = stage(work.join(part_groups(work), "part_id"))
    large = stage(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_lines).select("group"))
    usual = grouped.join(large, "group", "left_anti")
    done = [folded(usual.repartition("group").sortWithinPartitions("group", "request_id"))]
    if not large.isEmpty():
        done.append(in_rounds(grouped.join(large, "group", "left_semi").drop("group"), hot_rows))
    return done


def in_rounds(work: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(request_id, part_id, quantity, stock) → (request_id, accepted) over all tasks.

    A request that fits even if every open request before it were taken is taken; one that would not fit even if none
    of them were is refused; the rest wait. The first open request is always decided, so
    the rounds end, and each round looks only at parts that still have open requests.
    Every round is staged in the shared folder.
    """
    work = stage(work.withColumn("taken", F.lit(False)))
    decided = []
    while True:
        sums = {
            "upto_all": F.col("quantity"),
            "upto_taken": F.when(F.col("taken"), F.col("quantity")).otherwise(0),
        }
        running = running_sums(work, ["part_id"], ["request_id"], sums, hot_rows)
        fits_always = F.coalesce(F.col("upto_all") <= F.col("stock"), F.lit(True))
        never_fits = F.coalesce(F.col("upto_taken") + F.col("quantity") > F.col("stock"), F.lit(False))
        verdicts = stage(
            running.filter(~F.col("taken"))
            .groupBy("request_id")
            .agg(F.min(fits_always).alias("fits"), F.max(never_fits).alias("fails"))
            .select(
                "request_id", F.when(F.col("fails"), F.lit(False)).when(F.col("fits"), F.lit(True)).alias("accepted")
            )
        )
        decided.append(verdicts.filter(F.col("accepted").isNotNull()))
        still_open = verdicts.filter(F.col("accepted").isNull())
        if still_open.isEmpty():
            return reduce(DataFrame.unionByName, decided)
        work = _next_round(work, verdicts)


def _next_round(work: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop refused requests, mark taken ones, and keep only parts that still have open requests."""
    known = work.join(verdicts, "request_id", "left")
    kept = known.filter(F.col("taken") | F.coalesce("accepted", F.lit(True))).withColumn(
        "taken", F.col("taken") | F.coalesce("accepted", F.lit(False))
    )
    open_parts = kept.filter(~F.col("taken")).select("part_id").distinct()
    return stage(kept.join(open_parts, "part_id", "left_semi").select(*work.columns))


def admit_lines(parts: DataFrame, lines: DataFrame, arrival: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The lines with `accepted`, each a request of its own, in the order of arrival.

    Lines of different parts never compete, so a part's lines are sorted and folded in a task, which keeps no more than one
    number; parts of more than `hot_rows` contested lines take the rounds. What competes is judged once and written; the lines of
    other parts pass through and are not.
    """
    names = lines.columns
    # Written, it is a list of known size.
    short = stage(short_parts(parts, lines).select("part_id", F.col("stock").cast("long").alias("__stock")))
    met = lines.join(short, "part_id").select(*names, "__stock")
    competing = stage(met.filter(F.col("quantity").isNotNull()))
    unknown = met.filter(F.col("quantity").isNull()).select(*names)
    free = lines.join(short, "part_id", "left_anti").select(*names).unionByName(unknown).withColumn("accepted", F.lit(True))
    usual, hot = split_hot(competing, ["part_id"], hot_rows)
    out_schema = free.schema
    arrow = to_arrow_schema(out_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = left = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("part_id", "quantity", "__stock")]
            verdicts = []
            for p, quantity, stored in zip(*columns):
                if p != part:
                    part, left = p, stored
                verdicts.append(quantity <= left)
                if quantity <= left:
                    left -= quantity
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, pa.array(verdicts, pa.bool_())], arrow)], schema=arrow)

    folded = usual.repartition("part_id").sortWithinPartitions("part_id", *arrival).mapInArrow(fold, out_schema)
    judged = free.unionByName(stage(folded))
    if hot is None:
        return judged
    numbered = stage(row_numbers(hot, [], arrival, "request_id", hot_rows))
    verdicts = in_rounds(
        numbered.select("request_id", "part_id", F.col("quantity").cast("long"), F.col("__stock").alias("stock")), hot_rows
    )
    return judged.unionByName(numbered.join(verdicts, "request_id").select(*names, "accepted"))
