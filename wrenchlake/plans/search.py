"""Searching names for a whole table of texts.

Names are cut into all their pieces of one to three characters. A text's longest stretch without wildcards is cut likewise, and the
rarest of its longest pieces is what names and texts are joined on; LIKE decides about the candidates. So a text meets the
names that share its rarest piece instead of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.session import stage

PIECE = 3
#: A text's answers are made in tiles of about so many of its requests by so many of its names. The join holds a tile's names
#: as rows in memory up to 4096 of them.
TILE_REQUESTS, TILE_NAMES = 2048, 2048
#: Answers per task, about.
TASK_ROWS = 20_000_000
#: Requests that go with a name at a time. Rows of one name then follow one another, and the same requests come again and again.
RUN_REQUESTS = 128


def _pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of so many characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def names_like(names: DataFrame, key: str, name: str, requests: DataFrame) -> DataFrame:
    """(request_id, text) → (request_id, key, name): every row whose name holds the text, as LIKE '%text%' after trimming.

    % and _ in the text are wildcards, a backslash is itself. Texts under three characters use shorter pieces. A text without any other
    character than wildcards, as the empty one, is compared with every name; a null text or name matches nothing. Equal texts are
    searched once.
    """
    trimmed = requests.select("request_id", F.trim("text").alias("text")).filter(F.col("text").isNotNull())
    named = names.select(F.col(key), F.col(name)).filter(F.col(name).isNotNull())
    sizes = F.array(*[F.lit(k) for k in range(1, PIECE + 1)])
    index = stage(
        named.select(key, name, F.explode(sizes).alias("size"))
        .withColumn("piece", F.explode(_pieces(F.col(name), F.col("size"))))
        .select(key, name, "piece")
        # The empty piece stands for texts of wildcards only.
        .unionByName(named.withColumn("piece", F.lit("")))
    )
    texts = stage(trimmed.select("text").distinct())
    stretches = F.split("text", "[%_]+")
    longest = F.array_max(F.transform(stretches, lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]
    asked = texts.select("text", longest.alias("stretch"))
    size = F.least(F.length("stretch"), F.lit(PIECE))
    pieces = F.when(size > 0, _pieces(F.col("stretch"), size)).otherwise(F.array(F.lit("")))
    asked = asked.select("text", F.explode(pieces).alias("piece"))
    met = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(met, "piece", "left").groupBy("text")
    # A piece that no name holds is the rarest: the text then meets nothing.
    rarest = counted.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best")).select("text", "best.piece")
    pattern = F.concat(F.lit("%"), F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    found = stage(rarest.join(index, "piece").withColumn("pattern", pattern).filter(F.expr(f"`{name}` LIKE pattern")).select("text", key, name))
    return _answered(stage(trimmed), found, key, name)


def _answered(asked: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """(request_id, text) and (text, key, name), both staged → a row per request and name of its text.

    The answers are many more than both: every request of a text meets all its names. So they are dealt out by what they yield. A text's
    requests and names are cut into tiles, each request goes to all tiles of its row and each name to those of its column; a task
    holds the names of one tile, and there are as many tasks as the number of answers asks for.

    The answers are what takes disk, so they come in an order that columns store in little: requests travel in runs, and a run is given
    out whole for one name after another. Ids and names then repeat in long stretches, and the requests' ids in short cycles.
    """
    requests = asked.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    names = found.groupBy("text").agg(F.count(F.lit(1)).alias("m"))
    cuts = stage(
        requests.join(names, "text").select(
            "text",
            F.ceil(F.col("n") / TILE_REQUESTS).cast("int").alias("down"),
            F.ceil(F.col("m") / TILE_NAMES).cast("int").alias("across"),
            (F.col("n") * F.col("m")).alias("answers"),
        )
    )
    total = cuts.agg(F.sum("answers")).first()[0] or 0
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # By place, as many requests may share an id or have none.
    i = F.pmod(F.xxhash64("place"), F.col("down")).cast("int")
    j = F.pmod(F.xxhash64(key, name), F.col("across")).cast("int")
    placed = asked.withColumn("place", F.monotonically_increasing_id()).join(cuts, "text")
    packed = placed.groupBy("text", i.alias("i"), "across").agg(F.collect_list(F.struct("request_id")).alias("requests"))
    starts = F.sequence(F.lit(1), F.size("requests"), F.lit(RUN_REQUESTS))
    runs = F.explode(F.transform(starts, lambda k: F.slice(F.col("requests.request_id"), k, RUN_REQUESTS)))
    left = packed.select("text", "i", "across", runs.alias("run")).select("text", "run", "i", all_of("across").alias("j"))
    right = found.join(cuts, "text").select("text", key, name, all_of("down").alias("i"), j.alias("j"))
    tile = ["text", "i", "j"]
    # The number of tasks follows the answers; from the sizes of its inputs Spark would plan a few tasks, or a broadcast.
    met = left.repartition(tasks, *tile).join(right.repartition(tasks, *tile).hint("merge"), tile)
    return met.select(F.explode("run").alias("request_id"), key, name)
