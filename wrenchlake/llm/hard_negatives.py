"""Hard negatives of anchor vectors: rows of another label that score a little below a positive.

Scores are inner products of integer vectors. Anchors lie in blocks; a block's anchors are joined by a spanning tree of least distances. A task holds a
chunk of candidates and scores it exactly at the tree's root. From a parent's scores follow bounds at a child: they differ by
at most the length of the edge times the norm of the candidate. Only candidates whose bounds overlap a window of
the child are scored again, and have exact scores to hand on; the others hand on wider bounds. Levels of the tree are one array step.

Two passes of that kind: positives, where the window is everything from the worst of the best so far up, among rows of the anchor's label; then negatives, where
each positive has a window below its own score, narrowed from below by the worst of its best so far. A task keeps the best of
each anchor over its chunks and gives them out at its end; they are ranked together by Spark. Blocks of anchors are sent to the chunks in rounds of
bounded size (a checked broadcast), so candidates are never shuffled and no task holds more than a round of anchors.

Results for odd rows: rows with a null label, a null vector, or a null or non-finite component take no part; only vectors of one length meet;
the empty vector scores 0 with its like; repeated rows and rows with one vec_id are rows of their own, each an anchor where its id is
one, and may be each other's positives; a null vec_id is no anchor, is divisible by nothing, and comes last among equal scores; components are taken as exact integers however
large, a score beyond 64 bits comes out as null, and one beyond 38 digits counts as the greatest of 38; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import numbered, pa_schema
from wrenchlake.session import stage

POSITIVES, NEGATIVES = 5, 10
#: A negative scores from 30 to 90 hundredths of its positive.
LOW, HIGH = 30, 90
BLOCK_ANCHORS = 256
CHUNK_ROWS = 4096
#: Pairs scored again at a time.
TILE_PAIRS = 16_384
#: Bytes that the anchors sent to all tasks at a time may take there.
ROUND_BYTES = 64_000_000

_FOUND = "anchor long, slot int, score decimal(38,0), vec_id long, uid long"
_NO_ID = np.iinfo(np.int64).max
_MOST = 10**38 - 1


class Table(NamedTuple):
    """Vectors of one length with their labels; `whole` are the integer vectors, `norms` their lengths."""

    uids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    norms: np.ndarray


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component: doubles as long as all products stay exact, else Python integers."""
    dim = max(1, vectors.shape[1])
    scaled = np.floor(256 * vectors)
    if not scaled.size or dim * float(np.abs(scaled).max()) ** 2 < 2**53:
        return scaled
    exact = [math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def _table(uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Table:
    whole = whole_numbers(vectors)
    with np.errstate(over="ignore"):
        return Table(uids, ids, labels, whole, np.sqrt((_doubles(whole) ** 2).sum(axis=1)))


def _doubles(whole: np.ndarray) -> np.ndarray:
    """The nearest doubles; integers beyond their range become infinite."""
    if whole.dtype != object:
        return whole.astype(np.float64)
    near = [float(x) if abs(x) < 2**1023 else math.copysign(math.inf, x) for x in whole.ravel().tolist()]
    return np.array(near, np.float64).reshape(whole.shape)


def spanning_tree(whole: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels of a tree of least distances from row 0, and each row's parent and distance to it."""
    points = _doubles(whole)
    n = len(points)
    parent, edge, depth = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        open_[now] = False
        with np.errstate(invalid="ignore", over="ignore"):
            away = np.sqrt(((points - points[now]) ** 2).sum(axis=1))
        nearer = open_ & (away < edge)
        edge[nearer], parent[nearer] = away[nearer], now
        now = int(np.flatnonzero(open_)[np.argmin(edge[open_])])
        depth[now] = depth[parent[now]] + 1
    edge[0] = 0
    return [np.flatnonzero(depth == d) for d in range(depth.max() + 1)], parent, edge


class Best:
    """The best rows per slot so far; `floor` is the least score that may still enter."""

    def __init__(self, slots: int, keep: int) -> None:
        self.keep = keep
        self.rows: list[list[tuple]] = [[] for _ in range(slots)]
        self.floor = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Scores are exact numbers; only as many as can stay are looked at one by one."""
        order = np.lexsort((uids, ids, -score, slot)) if score.dtype != object else np.array(
            sorted(range(len(slot)), key=lambda k: (slot[k], -score[k], ids[k], uids[k])), np.int64
        )
        slot, score, ids, uids = slot[order], score[order], ids[order], uids[order]
        place = np.arange(len(slot))
        first = np.append(True, slot[1:] != slot[:-1])[: len(slot)]
        top = place - np.maximum.accumulate(np.where(first, place, 0)) < self.keep
        found: dict[int, list[tuple]] = {}
        for s, x, i, u in zip(slot[top].tolist(), score[top].tolist(), ids[top].tolist(), uids[top].tolist()):
            found.setdefault(s, []).append((-int(x), i, u))
        for s, rows in found.items():
            self.rows[s] = sorted(self.rows[s] + rows)[: self.keep]
            if len(self.rows[s]) == self.keep:
                self.floor[s] = _down(-self.rows[s][-1][0])


def _down(score: int) -> float:
    """A double not above the score."""
    near = _near(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def _up(score: int) -> float:
    """A double not below the score."""
    return -_down(-score)


def _near(score: int) -> float:
    return float(score) if abs(score) < 2**1023 else math.copysign(math.inf, score)


class Block:
    """A block of anchors with its tree, its windows and the best rows so far.

    A slot belongs to one anchor and takes scores from `low` to `high`; slots of an anchor stand side by side.
    """

    def __init__(self, anchors: Table, owner: np.ndarray, low: list[int | float], high: list[int | float], same: bool, keep: int) -> None:
        self.anchors, self.owner, self.same = anchors, owner, same
        self.whole_low, self.whole_high = np.array([*low, None], object)[:-1], np.array([*high, None], object)[:-1]
        self.low, self.high = (np.array([f(x) for x in v], np.float64) for f, v in ((_down, low), (_up, high)))
        self.first = np.searchsorted(owner, np.arange(len(anchors.ids) + 1))
        self.asks = np.flatnonzero(np.diff(self.first))  # anchors with a slot
        self.levels, self.parent, self.edge = spanning_tree(anchors.whole)
        self.best = Best(len(owner), keep)
        self.scored = 0

    def meet(self, chunk: Table) -> None:
        """Bound, score again where a window is met, and keep the best."""
        n = len(self.anchors.ids)
        lower, upper = np.empty((n, len(chunk.ids))), np.empty((n, len(chunk.ids)))
        floor = np.maximum(self.low, self.best.floor)
        # An anchor's windows together; anchors without a slot ask for nothing.
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        if len(self.asks):
            least[self.asks] = np.minimum.reduceat(floor, self.first[self.asks])
            most[self.asks] = np.maximum.reduceat(self.high, self.first[self.asks])
        for depth, level in enumerate(self.levels):
            if depth:
                # Rounding of lengths and of large scores is covered by a little more.
                slack = self.edge[level] * (1 + 1e-9) + 1e-12 * self.anchors.norms[level]
                with np.errstate(invalid="ignore", over="ignore"):
                    reach = slack[:, None] * chunk.norms[None, :] + 1
                    lower[level] = lower[self.parent[level]] - reach
                    upper[level] = upper[self.parent[level]] + reach
                wanted = ~(upper[level] < least[level][:, None]) & ~(lower[level] > most[level][:, None])
                like = self.anchors.labels[level][:, None] == chunk.labels[None, :]
                wanted &= like if self.same else ~like
                wanted &= (np.diff(self.first)[level] > 0)[:, None]
            else:
                wanted = np.ones((1, len(chunk.ids)), bool)
            at, who = np.nonzero(wanted)
            for low in range(0, len(at), TILE_PAIRS):
                a, c = level[at[low : low + TILE_PAIRS]], who[low : low + TILE_PAIRS]
                score = self._scores(a, c, chunk)
                lower[a, c] = upper[a, c] = _doubles(score)
                self._offer(a, c, score, chunk, floor)
                self.scored += len(a)

    def _scores(self, a: np.ndarray, c: np.ndarray, chunk: Table) -> np.ndarray:
        left, right = self.anchors.whole[a], chunk.whole[c]
        if left.dtype == object or right.dtype == object or not _exact(left, right):
            product = _objects(left) * _objects(right)
            return product.sum(axis=1) if product.shape[1] else np.zeros(len(a), object)
        return np.einsum("ij,ij->i", left, right)

    def _offer(self, a: np.ndarray, c: np.ndarray, score: np.ndarray, chunk: Table, floor: np.ndarray) -> None:
        fits = (self.anchors.labels[a] == chunk.labels[c]) == self.same
        fits &= self.anchors.uids[a] != chunk.uids[c]
        a, c, score = a[fits], c[fits], score[fits]
        number = np.diff(self.first)[a]
        pair = np.repeat(np.arange(len(a)), number)
        slot = np.repeat(self.first[a], number) + np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
        low, high = (self.whole_low, self.whole_high) if score.dtype == object else (floor, self.high)
        inside = ((score[pair] >= low[slot]) & (score[pair] <= high[slot])).astype(bool)
        if inside.any():
            pair, slot = pair[inside], slot[inside]
            self.best.add(slot, score[pair], chunk.ids[c[pair]], chunk.uids[c[pair]])


def _exact(left: np.ndarray, right: np.ndarray) -> bool:
    if not left.size:
        return True
    return left.shape[1] * float(np.abs(left).max()) * float(np.abs(right).max()) < 2**53


def _objects(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def clean(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, vector) of the rows that take part, staged: a uid stays the same in all later passes."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    )
    kept = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).withColumn("label", moved)
    return stage(kept.withColumn("uid", F.monotonically_increasing_id()))


def anchor_blocks(anchors: DataFrame, parts: int | None = None) -> DataFrame:
    """Anchors in numbered blocks of one vector length, by label, so that edges are short: (dim, block, anchors)."""
    placed = numbered(anchors.withColumn("dim", F.size("vector")), ["dim", "label", "vec_id", "uid"], "__n", parts)
    block = F.floor(F.col("__n") / BLOCK_ANCHORS)
    row = F.struct("__n", "uid", "vec_id", "label", "vector", "positives")
    grouped = placed.groupBy("dim", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("anchors"))
    return stage(grouped)


def _rounds(blocks: DataFrame) -> Iterator[DataFrame]:
    """The blocks, so many at a time that they and their best rows take ROUND_BYTES of a task at most."""
    sized = blocks.agg(F.max("block").alias("last"), F.max("dim").alias("dim")).first()
    if sized["last"] is None:
        return
    step = max(1, ROUND_BYTES // (BLOCK_ANCHORS * (24 * (sized["dim"] + 1) + 150 * POSITIVES * NEGATIVES)))
    for low in range(0, sized["last"] + 1, step):
        yield blocks.filter(F.col("block").between(low, low + step - 1))


def _pass(rows: DataFrame, blocks: DataFrame, positives: bool, keep: int) -> DataFrame | None:
    """(anchor, slot, score, vec_id, uid): each task's best rows per anchor and slot, for all blocks."""
    spark = rows.sparkSession
    types = pa_schema(spark, _FOUND)
    out = None
    for some in _rounds(blocks):
        sent = spark.sparkContext.broadcast(some.toArrow())  # bounded by _rounds

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value.combine_chunks()
            held: dict[int, list[Block]] = {}
            for batch in batches:
                for dim, chunk in _chunks(batch):
                    if dim not in held:
                        own = asked.filter(pc.equal(asked.column("dim"), dim))
                        held[dim] = [_block(own.column("anchors").take([k]).combine_chunks(), dim, positives, keep) for k in range(own.num_rows)]
                    for block in held[dim]:
                        block.meet(chunk)
            for block in (b for blocks_ in held.values() for b in blocks_):
                found = [
                    (int(block.anchors.uids[a]), s, -score, vec_id, uid)
                    for s, (a, best) in enumerate(zip(block.owner.tolist(), block.best.rows))
                    for score, vec_id, uid in best
                ]
                for at in range(0, len(found), 10_000):
                    yield _found(found[at : at + 10_000], block, types)

        one = stage(rows.select("uid", "vec_id", "label", "vector").mapInArrow(run, _FOUND))
        out = one if out is None else out.unionByName(one)
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, Table]]:
    """The rows of a batch by length of the vector, so many at a time."""
    size = np.asarray(pc.list_value_length(batch.column(3)))
    for dim in np.unique(size).tolist():
        own = batch.filter(pa.array(size == dim))
        for at in range(0, own.num_rows, CHUNK_ROWS):
            uids, ids, labels, vectors = own.slice(at, CHUNK_ROWS).columns
            values = vectors.flatten().to_numpy().reshape(len(uids), dim)
            yield dim, _table(uids.to_numpy(), ids.fill_null(_NO_ID).to_numpy(), labels.to_numpy(), values)


def _found(rows: list[tuple], block: Block, types: pa.Schema) -> pa.RecordBatch:
    first = np.searchsorted(block.owner, block.owner)
    anchor, slot, score, vec_id, uid = zip(*rows)
    columns = [
        pa.array(anchor, pa.int64()),
        pa.array([s - int(first[s]) for s in slot], pa.int32()),
        pa.array([Decimal(max(-_MOST, min(_MOST, x))) for x in score], pa.decimal128(38, 0)),
        pa.array([None if i == _NO_ID else i for i in vec_id], pa.int64()),
        pa.array(uid, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, types)], schema=types)


def _block(anchors: pa.Array, dim: int, positives: bool, keep: int) -> Block:
    rows = anchors.flatten()

    def field(name: str) -> pa.Array:
        return rows.flatten()[rows.type.get_field_index(name)]

    uids, labels = field("uid").to_numpy(), field("label").to_numpy()
    ids = field("vec_id").fill_null(_NO_ID).to_numpy()
    vectors = field("vector").flatten().to_numpy().reshape(len(uids), dim)
    table = _table(uids, ids, labels, vectors)
    if positives:
        return Block(table, np.arange(len(uids)), [-np.inf] * len(uids), [np.inf] * len(uids), True, keep)
    windows = field("positives").to_pylist()
    owner = np.repeat(np.arange(len(uids)), [len(w or ()) for w in windows])
    scores = [int(p["score"]) for w in windows for p in (w or ())]
    return Block(table, owner, [-(-LOW * p // 100) for p in scores], [HIGH * p // 100 for p in scores], False, keep)


def _first(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive."""
    spark = vectors.sparkSession
    rows = clean(vectors)
    slots = "array<struct<slot:int,vec_id:bigint,score:decimal(38,0)>>"
    anchors = rows.filter(is_anchor if is_anchor is not None else F.col("vec_id") % 100 == 0)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = _pass(rows, anchor_blocks(anchors.withColumn("positives", F.lit(None).cast(slots))), True, POSITIVES)
    if found is None:
        return spark.createDataFrame([], schema)
    first = _first(found, ["anchor"], POSITIVES)
    slot = F.struct((F.col("rank") - 1).alias("slot"), "vec_id", "score")
    positives = stage(first.groupBy("anchor").agg(F.sort_array(F.collect_list(slot)).alias("positives")))
    known = anchors.join(positives.withColumnRenamed("anchor", "uid"), "uid")
    negatives = _pass(rows, anchor_blocks(known), False, NEGATIVES)
    if negatives is None:
        return spark.createDataFrame([], schema)
    ranked = _first(negatives, ["anchor", "slot"], NEGATIVES).withColumnsRenamed(
        {"vec_id": "negative_id", "score": "negative_score"}
    )
    owners = known.select(
        F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.inline("positives").alias("slot", "positive_id", "positive_score")
    )
    return ranked.join(owners, ["anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        "negative_id",
        F.expr("try_cast(positive_score as long)").alias("positive_score"),
        F.expr("try_cast(negative_score as long)").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM pairs WHERE same)
  WHERE place <= 5
),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
