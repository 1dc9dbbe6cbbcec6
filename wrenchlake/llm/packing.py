"""Packing documents into sequences of bounded length: shortest pack first, over the histogram of lengths.

A document is its token ids and a closing id. One longer than a sequence is cut into full sequences and a rest. Only the
histogram of piece lengths (at most one row per possible length) comes to the driver, which packs counts instead of
pieces: lengths go longest first, each into the emptiest packs that can take it; packs that hold the same lengths are one pattern
with a count, and placing a length on some packs of a pattern splits the count. What fits nowhere opens packs
stacked as high as they go. Pieces then find their place by rank: within a length they are numbered, and each place of
a pattern owns an interval of these numbers. Work on the driver depends on the number of lengths, not of documents.

Null or empty text is the closing id alone. Repeated rows and equal ids are packed as rows of their own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.chunks import in_slices, taken, words_of
from wrenchlake.llm.common import arrow_pass, documents, worker_memory
from wrenchlake.llm.wordpieces import for_worker
from wrenchlake.session import stage

SEQUENCE = 4096
CLOSING_ID = 2
#: Bytes of text whose words are looked up together.
SLICE_BYTES = 8_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        words = for_worker(tokenizer, worker_memory("wordpieces"))
        end = closing.to_bytes(4, "little")
        row: list[int] = []
        out: dict[str, list] = {n: [] for n in ("start", "length", "ids_crc32", "doc_tokens")}
        done = 0
        for part in in_slices(batch, "text", SLICE_BYTES):
            chunks = words_of(part.column(part.schema.get_field_index("text")))
            distinct = chunks.distinct.to_pylist()
            known = words.learn(distinct)
            ids, bounds = taken(chunks, map(known.__getitem__, distinct))
            for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = (high - low) // 4 + 1
                for start in range(0, n, sequence):
                    length = min(sequence, n - start)
                    crc = zlib.crc32(ids[low + 4 * start : min(low + 4 * (start + length), high)])
                    row.append(done + k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(end, crc) if start + length == n else crc)
                    out["doc_tokens"].append(n)
            done += part.num_rows
        return out | {"doc_id": batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64()))}

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    return arrow_pass(docs.select("doc_id", "text"), rows, schema, "wordpieces")


def pack_histogram(histogram: Mapping[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, copies) in order of place]) that hold every counted length once."""
    made: list[list] = []  # count, places
    open_packs: list[tuple[int, int]] = []  # (minus the space left, pattern)

    def put(count: int, space: int, places: list[tuple[int, int]]) -> None:
        made.append([count, places])
        if space:
            heapq.heappush(open_packs, (-space, len(made) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and -open_packs[0][0] >= length:
            space, pattern = heapq.heappop(open_packs)
            count, places = made[pattern]
            used = min(count, left)
            made[pattern][0] = count - used
            if count > used:
                heapq.heappush(open_packs, (space, pattern))
            if places and places[-1][0] == length:
                grown = [*places[:-1], (length, places[-1][1] + 1)]
            else:
                grown = [*places, (length, 1)]
            put(used, -space - length, grown)
            left -= used
        stack = sequence // length
        if left >= stack:
            put(left // stack, sequence - stack * length, [(length, stack)])
        if left % stack:
            put(1, sequence - (left % stack) * length, [(length, left % stack)])
    return [(count, places) for count, places in made if count]


def places_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per place: (length, first rank, rank after the last, first sequence, copies, offset of the first copy)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, places in patterns:
        offset = 0
        for length, copies in places:
            low = ranks.get(length, 0)
            ranks[length] = low + count * copies
            out.append((length, low, ranks[length], sequence, copies, offset))
            offset += length * copies
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents with the sequence and the offset each is placed at."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer or default_tokenizer(), sequence)
    cut = stage(cut.withColumn("__part", F.spark_partition_id()))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `sequence` rows
    found = places_of(pack_histogram(histogram, sequence))
    schema = "__length long, __low long, __high long, __sequence long, __copies long, __offset long"
    places = F.broadcast(spark.createDataFrame(found, schema))

    counts = cut.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", "length", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", "length").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("__own", own).join(before, ["__part", "length"])
    rank = F.col("__before") + F.col("__own") - 1
    at = rank - F.col("__low")
    placed = ranked.join(places, (F.col("length") == F.col("__length")) & (rank >= F.col("__low")) & (rank < F.col("__high")))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("__sequence") + F.floor(at / F.col("__copies"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + (at % F.col("__copies")) * F.col("length")).cast("long").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
