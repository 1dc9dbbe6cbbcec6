"""Ranked lexical search over an index of postings by length stratum.

Documents of equal normaliser m are a stratum. The index is cut into shards of documents. A shard holds, per term, its
postings as groups of documents with one length and one term frequency; lengths become strata at search time, when the counts over all
documents are known. All documents of a group have the same impact, which is computed once. Per item a shard bounds each stratum by the sum of the impacts of the
greatest term frequencies there, visits strata from the greatest bound down, a few more each time, and stops below its
tenth score. Shards are searched apart, and their best documents are ranked together, so no task holds the postings of a frequent term.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. Scores are 64-bit integers, as
stated at `weights` and `normaliser`.

Results for odd rows: null or empty text, or text without terms, is in no stratum and never found; very long texts are cut at ends of
terms while they are counted and are one document; repeated rows and equal or null doc_ids are documents of their own (nulls come last among
equal scores); repeated rows of an item are one item, other texts of the same or a null item_id are items of their own; items without terms, and an
empty table on either side, give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.chunks import flat, numbered_chunks
from wrenchlake.llm.common import checked_broadcast, documents, groups, pa_schema
from wrenchlake.session import new_shared_folder, stage

TOP = 10
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Bytes of text whose terms are counted at a time.
COUNT_BYTES = 2_000_000
#: Items searched together in a shard, about.
BLOCK_ITEMS = 500
#: Strata visited first; each further visit doubles the number.
FIRST_STRATA = 8

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_ID = np.iinfo(np.int64).max

_POSTINGS = "shard long, term string, lengths array<int>, tfs array<int>, sizes array<int>, docs array<int>"


def normaliser(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of a document of n terms: 10 + (90 * n * N) div L."""
    return 10 + (90 * n * n_docs) // n_terms


def terms_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Term number and text number of every term occurrence, and the distinct terms."""
    inside = _TERM_BYTE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    text = np.searchsorted(bounds, starts, side="right") - 1
    # Without the bytes between terms, terms fill the buffer.
    kept = np.cumsum(inside)
    chunks = numbered_chunks(_LOWER[raw[inside]], kept[starts] - 1, np.zeros(0, np.int64))
    return np.asarray(chunks.codes).astype(np.int64), text, chunks.distinct


class Shard:
    """Counts of the terms of some documents."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.names: list[pa.Array] = []
        self.counts: list[np.ndarray] = []  # rows of (term of its block, document, count)
        self.docs = self.bytes = 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        raw, bounds = flat(texts)
        for low, high in _blocks(raw):
            inner = np.clip(bounds, low, high) - low
            code, text, distinct = terms_of(raw[low:high], inner)
            key, count = np.unique(code * len(ids) + text, return_counts=True)
            self.names.append(distinct)
            self.counts.append(np.stack((key // len(ids), key % len(ids) + self.docs, count)))
        self.ids.append(ids)
        self.docs += len(ids)
        self.bytes += len(raw)

    def rows(self, shard: int, types: pa.Schema) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        """The shard's postings, a row per term, and its documents with their lengths."""
        names = pa.chunked_array(self.names, pa.string()).dictionary_encode().combine_chunks() if self.names else None
        if isinstance(names, pa.ChunkedArray):
            names = names.chunk(0)
        code = np.asarray(names.indices).astype(np.int64) if names is not None else np.zeros(0, np.int64)
        at = np.cumsum([0, *map(len, self.names)])
        term, doc, count = (
            np.concatenate([np.zeros((3, 0), np.int64), *[np.stack((code[o + c[0]], c[1], c[2])) for o, c in zip(at, self.counts)]], axis=1)
        )
        length = np.bincount(doc, weights=count, minlength=self.docs).astype(np.int64)
        # A term cut off from its document's other blocks is summed up here.
        key, back = np.unique(term * max(self.docs, 1) + doc, return_inverse=True)
        tf = np.bincount(back, weights=count, minlength=len(key)).astype(np.int64)
        term, doc = key // max(self.docs, 1), key % max(self.docs, 1)
        order = np.lexsort((tf, length[doc], term))
        term, doc, tf = term[order], doc[order], tf[order]
        fresh = np.append(True, (term[1:] != term[:-1]) | (length[doc[1:]] != length[doc[:-1]]) | (tf[1:] != tf[:-1]))[: len(term)]
        first = np.flatnonzero(fresh)
        group_term = term[first]
        opens = np.flatnonzero(np.append(True, group_term[1:] != group_term[:-1])[: len(first)])
        by_group = pa.array(np.append(opens, len(first)).astype(np.int32))
        by_doc = pa.array(np.append(first[opens], len(term)).astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(by_group, pa.array(v.astype(np.int32)))
            for v in (length[doc[first]], tf[first], np.diff(np.append(first, len(term))))
        ]
        docs = pa.ListArray.from_arrays(by_doc, pa.array(doc.astype(np.int32)))
        named = names.dictionary.take(pa.array(group_term[opens])) if names is not None else pa.array([], pa.string())
        columns = [pa.array(np.full(len(opens), shard)), named, *lists, docs]
        batch = pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, types)], schema=types)
        return batch, (np.concatenate([np.zeros(0, np.int64), *self.ids]), length)


def _blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a buffer after about COUNT_BYTES, at bytes that are in no term."""
    low = 0
    while low < len(raw):
        high = min(low + COUNT_BYTES, len(raw))
        while high < len(raw) and _TERM_BYTE[raw[high]]:
            more = np.flatnonzero(~_TERM_BYTE[raw[high : high + 4096]])
            high = high + int(more[0]) if len(more) else min(high + 4096, len(raw))
        yield low, high
        low = high


def build_index(docs: DataFrame, folder: str) -> None:
    """Write the index of all documents to a folder: `postings` (a row per shard and term, and one with the null term that lists the shard's documents).

    The null term's row holds each document's length in `lengths` and its doc_id, in two halves of 32 bits, in `tfs` and
    `sizes`; `docs` marks ids that are null. One pass over the texts, without a shuffle.
    """
    types = pa_schema(docs.sparkSession, _POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard = TaskContext.get().partitionId(), 0, Shard()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, shard
            rows, (ids, length) = shard.rows((task << 32) + made, types)
            for at in range(0, rows.num_rows, 10_000):
                yield rows.slice(at, 10_000)
            halves = ids.view(np.int32).reshape(-1, 2)
            lists = [length, halves[:, 0], halves[:, 1], ids == _NO_ID]
            columns = [pa.array([(task << 32) + made]), pa.array([None], pa.string())]
            columns += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, types)], schema=types)
            made, shard = made + 1, Shard()

        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column(0).cast(pa.int64()), _NO_ID))
            texts = pc.fill_null(batch.column(1), "")
            size = np.asarray(pc.binary_length(texts), np.int64)
            low = 0
            while low < batch.num_rows:
                room = max(SHARD_BYTES - shard.bytes, 0)
                high = low + max(1, int(np.searchsorted(np.cumsum(size[low:]), room, side="right")))
                shard.add(ids[low:high], texts.slice(low, high - low))
                low = high
                if shard.bytes >= SHARD_BYTES or low < batch.num_rows:
                    yield from close()
        if shard.docs:
            yield from close()

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _POSTINGS).write.option("compression", "zstd").parquet(folder)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of each distinct item, numbered."""
    distinct = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    numbered = stage(distinct.withColumn("item", F.monotonically_increasing_id()))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.filter(F.array_distinct(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), lambda t: t != "")
    return stage(numbered.select("item", "item_id", F.explode(terms).alias("term")))


def totals(hits: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    listed = F.filter("lengths", lambda n: n > 0)
    found = hits.filter(F.col("term").isNull()).agg(
        F.sum(F.size(listed).cast("long")).alias("n_docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_terms"),
    )
    row = found.first()
    return row["n_docs"] or 0, row["n_terms"] or 0


def weights(hits: DataFrame, n_docs: int) -> DataFrame:
    """(term, weight): floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term that some document holds."""
    df = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    known = hits.filter(F.col("term").isNotNull()).groupBy("term").agg(df.alias("df"))
    return known.select("term", weight.cast("long").alias("weight"))


def best_of_shard(
    length: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray, ids: np.ndarray, m: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray]:
    """The best documents of a shard for one item, and their scores.

    `postings` holds per term (strata, impacts, sizes, docs) of its groups; m the strata of the documents.
    """
    strata = np.concatenate([p[0] for p in postings])
    term = np.repeat(np.arange(len(postings)), [len(p[0]) for p in postings])
    gain = np.concatenate([p[1] * w for p, w in zip(postings, weight.tolist())])
    size = np.concatenate([p[2] for p in postings])
    docs = np.concatenate([p[3] for p in postings])
    # Groups of a term are in order of stratum, so each (term, stratum) is one run, and its greatest gain counts.
    runs = np.flatnonzero(np.append(True, (strata[1:] != strata[:-1]) | (term[1:] != term[:-1])))
    most = np.maximum.reduceat(gain, runs)
    names, place = np.unique(strata[runs], return_inverse=True)
    bound = np.zeros(len(names), np.int64)
    np.add.at(bound, place, most)
    order = np.argsort(-bound, kind="stable")
    of_group = np.searchsorted(names, strata)
    visited = np.empty(len(names), np.int64)
    visited[order] = np.arange(len(names))
    turn = np.repeat(visited[of_group], size)
    gains = np.repeat(gain, size)
    score = np.zeros(len(m), np.int64)
    low, step, floor = 0, FIRST_STRATA, 0
    found = np.zeros(0, np.int64)
    while low < len(names) and bound[order[low]] > 0 and bound[order[low]] >= floor:
        now = (turn >= low) & (turn < low + step)
        np.add.at(score, docs[now], gains[now])
        found = np.union1d(found, docs[now])
        found = found[score[found] > 0]
        if len(found) > top:
            found = found[np.lexsort((found, ids[found], -score[found]))[:top]]
        if len(found) == top:
            floor = score[found].min()
        low, step = low + step, step * 2
    return found, score[found]


def search(spark: SparkSession, folder: str, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of the index for each item, scores above 0 only."""
    index = spark.read.parquet(folder)
    asked = item_terms(items)
    blocks = max(1, -(-asked.select("item").distinct().count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    terms = stage(asked.select("term").distinct())
    wanted = F.col("term").isNull()
    hits = stage(
        index.filter(~wanted).join(checked_broadcast(terms), "term", "left_semi").select(*index.columns).unionByName(index.filter(wanted))
    )
    n_docs, n_terms = totals(hits)
    weighed = stage(weights(hits, n_docs))
    # Per block of items a term's postings go out once, with the items that ask for it. 
    asking = (
        asked.withColumn("block", block)
        .join(checked_broadcast(weighed), "term")
        .groupBy("block", "term", "weight")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    asking = stage(asking)
    found = hits.join(checked_broadcast(asking), "term").select(*index.columns, "block", "weight", "items")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    members = hits.filter(wanted).select(*index.columns, all_blocks.alias("block"))
    schema = "item long, doc_id long, score long"
    types = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["shard", "block"]):
            yield from _search_shard(table.combine_chunks(), n_docs, n_terms, top, types)

    best = (
        members.unionByName(found, allowMissingColumns=True)
        .repartition("shard", "block")
        .sortWithinPartitions("shard", "block", F.col("term").asc_nulls_first())
        .mapInArrow(run, schema)
    )
    own = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)
    names = checked_broadcast(asked.select("item", "item_id").distinct())
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_shard(table: pa.Table, n_docs: int, n_terms: int, top: int, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one shard and block: first its documents, then the postings of the terms that are asked for."""
    rows = table.to_batches()[0]

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(rows.schema.get_field_index(name))
        size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        return np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(size)))

    if rows.num_rows < 2:
        return
    lengths, at_group = lists("lengths")
    tfs, _ = lists("tfs")
    sizes, _ = lists("sizes")
    docs, at_doc = lists("docs")
    items, at_item = lists("items")
    weight = np.asarray(pc.fill_null(rows.column(rows.schema.get_field_index("weight")), 0), np.int64)
    n = at_group[1]
    length = lengths[:n].astype(np.int64)
    ids = np.stack((tfs[:n], sizes[:n]), axis=1).astype(np.int32).view(np.int64).ravel()
    m = normaliser(length, n_docs, n_terms)
    postings = []
    for k in range(1, rows.num_rows):
        a, b = at_group[k], at_group[k + 1]
        strata = normaliser(lengths[a:b].astype(np.int64), n_docs, n_terms)
        tf = tfs[a:b].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * strata)
        postings.append((strata, impact, sizes[a:b].astype(np.int64), docs[at_doc[k] : at_doc[k + 1]].astype(np.int64)))
    row = np.repeat(np.arange(rows.num_rows), np.diff(at_item))
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(items)]):
        own = row[a:b]
        found, score = best_of_shard(length, [postings[k - 1] for k in own.tolist()], weight[own], ids, m, top)
        out.append((np.full(len(found), items[a]), ids[found], score))
    if out:
        item, doc_id, score = (np.concatenate(x) for x in zip(*out))
        none = pa.array(doc_id == _NO_ID)
        columns = [pa.array(item), pc.if_else(none, None, pa.array(doc_id)), pa.array(score)]
        yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, types)], schema=types)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_shared_folder(spark)
    build_index(documents(spark, sf_dir), folder)
    return search(spark, folder, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _sql_terms(columns: str, table: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {columns}, unnest(regexp_extract_all({lower}, '{_RUNS}')) AS term FROM {table}"


SQL = f"""
WITH words AS ({_sql_terms("doc_id", "documents")}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
norms AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM lengths, totals),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
),
asked AS (SELECT DISTINCT * FROM ({_sql_terms("item_id", "benchmark")})),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
