"""Mixing sources to target weights along a time-varying curriculum.

**Targets.** Sources in code point order (null last) weigh 5, 2, 1, repeating. Together they get `SHARE` times all words, by
weight, but no source more than `REPEATS` times its own; what a full source leaves is shared by weight among the rest, until none is
above. With weights w and caps c this is min(c, level * w) for one level, found by rounds of aggregations over the
source table: each round fills at least one source, and all with the same ratio at once.

**Curriculum.** Training time runs from 0 to 1. The demand of a source with target T changes linearly: T * (1 + s * (2t - 1)), where
the slope s is `SLOPE` for sources of the first weight (demanded late), minus that for the second, 0 for the third. Its integral is
the words demanded by then, D(t) = T * (t + s * (t^2 - t)). A source deals its documents in the order of a hash of their
id, again from the start when it has dealt all. A document's words begin at an offset of that stream, and the training
position of this take is the t at which the demand reaches the offset: the root of the quadratic. Sorting takes by position gives the curriculum.

**Takes.** The stream ends at the target, within a document where it must, so each source's words are its target rounded down.

Running sums are cut in two levels (hash bucket, then inside the bucket), so a source with a third of all rows is dealt over
many tasks. Null or empty texts have size 0 and are never taken. Repeated rows each count; equal ids follow each other in
the order of text. A null id hashes like any value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import WORD, documents, join_counted, numbered
from wrenchlake.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SLOPE = 0.8
#: Rows in a bucket of the running sums, on average.
BUCKET_ROWS = 2_000

def _order_hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, weight, source_size, docs, target), one row per source."""
    per = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    ranked = numbered(per, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    sources = stage(ranked.select("source", "source_size", "docs", weight.alias("weight")))
    full = repeats * F.col("source_size")
    level = 0.0
    while True:
        # The level rises from round to round, so a source that is full stays full.
        is_full = full <= F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(is_full, full)), F.lit(0)).alias("full"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).first()
        if not sums["open"]:
            break
        risen = (share * sums["all"] - sums["full"]) / sums["open"]
        if risen <= level:
            break
        level = risen
    target = F.least(full.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def _sizes(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    return docs.select("doc_id", "source", words.alias("size"), _order_hash().alias("__h"), tie.alias("__tie"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, and `epochs`, an array of (epoch, taken, position)."""
    return _take(stage(_sizes(docs))).drop("__tie")


def _take(sizes: DataFrame) -> DataFrame:
    rows = sizes.count()
    targets = stage(source_targets(sizes))
    # As many buckets for each source as the table needs: every source is spread in the same way.
    bits = min(40, max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))
    bucket = F.expr(f"cast(conv(substr(__h, 1, 10), 16, 10) as long) div {2 ** (40 - bits)}")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    placed = join_counted(sizes, targets, "source", "docs", rows).withColumns({"__key": key, "__bucket": bucket})
    sums = placed.groupBy("__key", "__bucket").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__key", "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    upto = (
        Window.partitionBy("__key", "__bucket")
        .orderBy("__h", "__tie", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = placed.withColumn("__own", F.sum("size").over(upto) - F.col("size"))
    joined = local.join(before, ["__key", "__bucket"]).withColumn("__offset", F.col("__own") + F.col("__before"))
    words = F.floor("target").cast("long")
    epochs = []
    for epoch in range(REPEATS):
        start = F.col("__offset") + F.col("source_size") * epoch
        taken = F.greatest(F.lit(0), F.least(F.col("size"), words - start)).cast("long")
        epochs.append(F.struct(F.lit(epoch).alias("epoch"), taken.alias("taken"), position(start).alias("position")))
    return (
        joined.withColumn("epochs", F.filter(F.array(*epochs), lambda e: e["taken"] > 0))
        .withColumn("taken", F.aggregate("epochs", F.lit(0).cast("long"), lambda a, e: a + e["taken"]))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "__tie")
    )


def position(offset: Column) -> Column:
    """The training time at which a source's demand reaches the offset: t + s * (t^2 - t) = offset / target."""
    share = F.least(F.lit(1.0), offset / F.col("target"))
    slope = F.when(F.col("weight") == WEIGHTS[0], SLOPE).when(F.col("weight") == WEIGHTS[1], -SLOPE).otherwise(0.0)
    # The form of the root that has no division by the slope.
    root = 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))
    return F.when((F.col("target") > 0) & (offset >= 0), F.when(share > 0, root).otherwise(0.0))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row per take, range-sorted by position, with the columns of `docs`.

    A take that ends inside a document has its first words, joined by blanks, and n_chars follows if there is such a column.
    """
    names = docs.columns
    takes = stage(_take(stage(_sizes(docs))))
    # The hash of the text and the source tell apart different rows of one id.
    key = {"__id": F.col("doc_id"), "__src": F.col("source"), "__t": F.coalesce(F.xxhash64("text"), F.lit(0))}
    asked = takes.select(
        F.col("doc_id").alias("__id2"),
        F.col("source").alias("__src2"),
        F.col("__tie").alias("__t2"),
        F.col("size").alias("__size"),
        F.col("epochs").alias("__epochs"),
    )
    own = docs.withColumns(key)
    match = (
        F.col("__id").eqNullSafe(F.col("__id2"))
        & F.col("__src").eqNullSafe(F.col("__src2"))
        & (F.col("__t") == F.col("__t2"))
    )
    if not takes.groupBy("doc_id", "source", "__tie").count().filter("count > 1").isEmpty():
        # Equal rows are told apart by a number, so each gets the take of one.
        number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
        own = own.withColumn("__n", number("__id", "__src", "__t"))
        asked = asked.withColumn("__n2", number("__id2", "__src2", "__t2"))
        match = match & (F.col("__n") == F.col("__n2"))
    taken = own.join(asked.filter(F.size("__epochs") > 0), match).withColumn("__e", F.explode("__epochs"))
    whole = F.col("__e.taken") == F.col("__size")
    first = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, F.col("__e.taken").cast("int"))
    out = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(first, " ")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, F.col("__e.position"), "doc_id").sortWithinPartitions(
        F.col("__e.position"), "doc_id"
    ).select(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    first = F.element_at(F.col("epochs.position"), 1)
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.size("epochs") > 0, first).alias("first_position")
    )


SQL = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM per),
r AS (SELECT *, {REPEATS} * source_size / CAST(weight AS DOUBLE) AS ratio FROM w),
cut AS (SELECT x.ratio, coalesce(sum(y.source_size) FILTER (y.ratio <= x.ratio), 0) * {REPEATS} AS filled,
        sum(y.weight) FILTER (y.ratio > x.ratio) AS open
        FROM (SELECT ratio FROM r UNION SELECT -1) AS x, r AS y GROUP BY x.ratio),
level AS (SELECT max(({SHARE}::DOUBLE * (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) - filled) / open) AS level FROM cut WHERE open > 0),
t AS (SELECT *, least({REPEATS}::DOUBLE * source_size, level * weight) AS target,
        CASE weight WHEN {WEIGHTS[0]} THEN {SLOPE}::DOUBLE WHEN {WEIGHTS[1]} THEN -{SLOPE}::DOUBLE ELSE 0::DOUBLE END AS slope FROM w, level),
o AS (SELECT doc_id, size, source_size, target, slope, CAST(floor(target) AS BIGINT) AS words,
        CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, words - start)) AS first, greatest(0, least(size, words - start - source_size)) AS second,
        CASE WHEN target > 0 THEN least(1::DOUBLE, start / target) END AS share FROM o)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken,
  CASE WHEN first > 0 THEN 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END AS first_position
FROM k"""
