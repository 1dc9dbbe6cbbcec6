"""Exact Jaccard self-join on word shingles, by adaptive multi-match prefixes.

Shingles have one order: rare ones first. Two documents that reach the threshold share at least `o` shingles, `o` being the
threshold times a document's size, so their prefixes of length size - o + l share at least l of them, whatever l is. Each document
picks its own l: a longer prefix costs more index entries, but a partner then has to be met l times, so at most
(entries met) / l partners are left to verify. The estimates come from a table of shingle counts by hash, of fixed size, made over all documents.
A pair has to share min(l, l') prefix shingles.

Three things keep frequent shingles and large groups from making all pairs:

* documents with equal sets are one node, whose copies are only counted;
* shingles in the prefixes of at most `HOT_NODES` nodes yield pairs, which are counted; nodes that meet in a more frequent one are tied to
  that shingle's first node instead;
* these ties and pairs are only candidates. Their connected components are verified as groups, cut into pairs of blocks of
  `BLOCK` nodes; a block pair counts shared prefix shingles and then, for pairs that have enough, shared shingles exactly, by matrix products, and returns
  a spanning forest of its links. No link between different sets is lost, and no task holds more than two blocks.

Shingles are compared by 64-bit hashes, sets by 128-bit digests of these. Null text or one without words has an empty set and no links.
Repeated rows are copies. A component's id is its smallest doc_id; rows with a null id take part, and have null only if no id is reachable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm.common import (
    arrow_pass,
    checked_broadcast,
    components,
    documents,
    groups,
    join_counted,
    numbered,
    pa_schema,
    sliced,
)
from wrenchlake.llm.hashing import batches_of, shingle_sets
from wrenchlake.session import stage

WIDTH, PERCENT = 4, 85
#: log2 of the number of counters for shingle counts.
COUNTER_BITS = 20
#: Longest match count a document may ask for.
MOST_MATCHES = 6
HOT_NODES = 128
BLOCK = 256
#: Entries of sets compared at a time.
RANGE_ENTRIES = 500_000
#: Costs in the estimate: an index entry, and verifying a partner per shingle.
ENTRY_COST, VERIFY_COST, RARE_COUNT = 4.0, 0.06, 0.25


def count_table(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by the top bits of their hash, over all documents.

    Shingles that share a counter are counted together; a frequent one still stands out from what each counter holds on average.
    """
    slices = 64
    types = pa_schema(docs.sparkSession, "slice int, counts binary")
    per_slice = (1 << COUNTER_BITS) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in sliced(batches):
            for texts in batches_of(batch.column(0).to_pylist()):
                found = np.concatenate(shingle_sets(texts, width))
                counts += np.bincount((found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
        if counts.any():
            yield pa.RecordBatch.from_pydict(
                {"slice": list(range(slices)), "counts": [x.tobytes() for x in counts.reshape(slices, -1)]},
                schema=types,
            )

    def add(pdf):
        import pandas as pd

        total = np.zeros(per_slice, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.tobytes()]})

    summed = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice")
    table = np.zeros((slices, per_slice), np.int64)
    for row in summed.applyInPandas(add, "slice int, counts binary").collect():  # a table of fixed size
        table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)


def choose_prefix(found: np.ndarray, table: np.ndarray, usual: float, percent: int) -> tuple[int, np.ndarray]:
    """The document's match count and prefix: shingles by (count, hash), cut where the estimated cost is least.

    `usual` is what a counter holds on average; what it holds beyond is the estimate for the shingle.
    """
    n = len(found)
    needed = -(-percent * n // 100)
    counts = table[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    ordered = found[np.lexsort((found, counts))]
    met = np.cumsum(np.maximum(np.sort(counts) - 1.5 * usual, RARE_COUNT))
    best, cost = 1, np.inf
    for matches in range(1, min(MOST_MATCHES, needed) + 1):
        length = n - needed + matches
        estimate = ENTRY_COST * length + met[length - 1] * (1 + VERIFY_COST * n / matches)
        if estimate < cost:
            best, cost = matches, estimate
    return best, ordered[: n - needed + best]


def prefixes(docs: DataFrame, table: Broadcast, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n (set size), digest (of the set; null if empty), matches, prefix."""
    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        usual = float(table.value.mean())
        out: dict[str, list] = {"n": [], "digest": [], "matches": [], "prefix": []}
        for texts in batches_of(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            for found in shingle_sets(texts, width):
                matches, prefix = choose_prefix(found, table.value, usual, percent) if len(found) else (0, found)
                out["n"].append(len(found))
                out["digest"].append(set_digest(found) if len(found) else None)
                out["matches"].append(matches)
                out["prefix"].append(prefix.astype(np.int64))
        return out | {n: batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "th")}

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th long, n long, digest binary, matches int, prefix array<long>"
    return arrow_pass(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), rows, schema)


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def texts_by_digest(docs: DataFrame, width: int) -> DataFrame:
    """(text, digest) of the rows with words."""
    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column(0)
        sets = [found for run in batches_of(texts.to_pylist()) for found in shingle_sets(run, width)]
        return {"text": texts, "digest": [set_digest(x) if len(x) else None for x in sets]}

    return arrow_pass(docs.select("text"), rows, "text string, digest binary").filter("digest is not null")


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that may reach the threshold."""
    entries = nodes.select(F.explode("prefix").alias("token"), "node", "n", "matches")
    shared = stage(
        entries.groupBy("token")
        .agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first"))
        .filter("nodes > 1")
    )
    live = stage(entries.join(shared, "token"))
    cold = live.filter(F.col("nodes") <= HOT_NODES)
    a = cold.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("matches").alias("ma"))
    b = cold.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("mb"))
    pairs = (
        a.join(b, "token")
        .filter(F.col("a") < F.col("b"))
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("ma", "mb")).alias("needed"))
        .filter("met >= needed")
        .select("a", "b")
    )
    ties = live.filter((F.col("nodes") > HOT_NODES) & (F.col("node") != F.col("first")))
    return pairs.union(ties.select(F.col("first").alias("a"), F.col("node").alias("b")))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many entries each two sets share: products of their incidence matrix, a run of entries at a time.

    The entries are taken by ranges of their hash, as many ranges as keep one at about `RANGE_ENTRIES` entries.
    """
    k = len(sets)
    common = np.zeros((k, k), np.float32)
    sets = [np.sort(s) for s in sets]
    ranges = max(1, -(-sum(len(s) for s in sets) // RANGE_ENTRIES))
    edges = [np.searchsorted(s, np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)) for s in sets]
    edges = [np.concatenate(([0], e, [len(s)])).astype(np.int64) for e, s in zip(edges, sets)]
    for r in range(ranges):
        part = [s[e[r] : e[r + 1]] for s, e in zip(sets, edges)]
        row = np.repeat(np.arange(k), [len(s) for s in part])
        _, where, counts = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        used = counts[where] > 1
        row, column = row[used], (np.cumsum(counts > 1) - 1)[where[used]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        for low in range(0, width, 2048):
            lo, hi = np.searchsorted(column, (low, low + 2048))
            matrix = np.zeros((k, min(2048, width - low)), np.float32)
            matrix[row[lo:hi], column[lo:hi] - low] = 1
            common += matrix @ matrix.T
    np.fill_diagonal(common, [len(s) for s in sets])
    return common.astype(np.int64)


def connected(linked: np.ndarray) -> list[np.ndarray]:
    """Components of a symmetric boolean matrix, those of one row left out."""
    open_, out = linked.any(1), []
    for start in range(len(linked)):
        if open_[start]:
            reached = np.zeros(len(linked), bool)
            front = np.zeros(len(linked), bool)
            front[start] = True
            while front.any():
                reached |= front
                front = linked[front].any(0) & ~reached
            open_ &= ~reached
            if reached.sum() > 1:
                out.append(np.flatnonzero(reached))
    return out


def forest(
    sets: list[np.ndarray], prefixes: list[np.ndarray], matches: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links among the sets that connect all that links connect; a set is linked to its component's first.

    Prefixes choose the pairs to verify here too; the whole sets of those are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    asked = common_counts(prefixes) >= np.minimum(matches[:, None], matches[None, :])
    asked &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    np.fill_diagonal(asked, False)
    out = []
    for members in connected(asked):
        inter = common_counts([sets[i] for i in members])
        own = sizes[members]
        linked = 100 * inter >= percent * (own[:, None] + own[None, :] - inter)
        for part in connected(linked):
            out += [(int(members[part[0]]), int(members[i])) for i in part[1:]]
    return out


def verified(
    docs: DataFrame, nodes: DataFrame, grouped: DataFrame, table: Broadcast, width: int, percent: int
) -> DataFrame:
    """Verified edges (a, b) between nodes of the same candidate group; `grouped` has (node, root)."""
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own"))
    )
    placed = stage(
        grouped.join(sizes, "root")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", other)
        .join(nodes.select("node", F.col("owner").alias("__owner"), "digest"), "node")
        .select("node", "root", "own", "other", "__owner", "digest")
    )
    texts = docs.select("doc_id", "text").join(checked_broadcast(placed), F.col("doc_id") == F.col("__owner"))
    nameless = placed.filter("__owner is null")
    if not nameless.isEmpty():
        # A set without any doc_id is found by its digest; one text of each set is enough.
        found = texts_by_digest(docs.filter("doc_id is null"), width).dropDuplicates(["digest"])
        found = found.select("text", F.col("digest").alias("__d"))
        more = found.join(checked_broadcast(nameless), F.col("digest") == F.col("__d"))
        texts = texts.select(*placed.columns, "text").unionByName(more.select(*placed.columns, "text"))
    dealt = texts.select(
        "node",
        "root",
        "digest",
        F.explode("other").alias("with"),
        "own",
        "text",
    ).select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "digest", "text")
    schema = "a long, b long"
    types = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = float(table.value.mean())
        for group in groups(batches, ["root", "i", "j"]):
            sets: list[np.ndarray] = []
            for texts in batches_of(group["text"].to_pylist()):
                sets += shingle_sets(texts, width)
            held: dict[int, np.ndarray] = {}
            # Rows of one id may have several texts; the node is the one with its digest.
            for node, digest, found in zip(group["node"].to_pylist(), group["digest"].to_pylist(), sets):
                if set_digest(found) == digest:
                    held[node] = found
            ids = list(held)
            if len(ids) > 1:
                chosen = [choose_prefix(x, table.value, usual, percent) for x in held.values()]
                links = forest(list(held.values()), [p for _, p in chosen], np.array([m for m, _ in chosen]), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[x] for x, _ in links], pa.int64()), pa.array([ids[y] for _, y in links], pa.int64())],
                    schema=types,
                )

    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, schema)


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return grouped_rows(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, th, n, component_id, and a number of the component, which is null for an empty set."""
    table = docs.sparkSession.sparkContext.broadcast(count_table(docs, width))  # of fixed size
    rows = stage(prefixes(docs, table, width, percent))
    filled = rows.filter("n > 0")
    per_set = filled.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    sets = stage(numbered(per_set, ["digest"], "node"))
    own = ["digest", "n", "matches", "prefix"]
    owned = sets.withColumnRenamed("digest", "__d")
    named = filled.join(owned, (F.col("digest") == F.col("__d")) & (F.col("doc_id") == F.col("owner")))
    # Sets found only in rows without a doc_id; all rows of a set have the same prefix.
    nameless = filled.filter("doc_id is null").dropDuplicates(["digest"]).select(*own)
    nameless = nameless.join(owned.filter("owner is null"), F.col("digest") == F.col("__d"))
    names = ["node", "owner", *own]
    nodes = stage(named.select(*names).unionByName(nameless.select(*names)).dropDuplicates(["node"]))
    grouped = components(candidates(nodes, percent))
    links = components(verified(docs, nodes, grouped, table, width, percent))
    owned = links.join(sets.select("node", "owner"), "node")
    least = owned.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = owned.join(least, "root").select("node", "root", "component_id")
    keyed = stage(
        sets.join(named, "node", "left").select(
            "digest",
            "copies",
            F.coalesce("component_id", "owner").alias("component_id"),
            F.coalesce("root", "node").alias("component"),
        )
    )
    joined = join_counted(filled, keyed, "digest", "copies", filled.count())
    empty = rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    names = ["doc_id", "th", "n", "component_id", "component"]
    return joined.select(*names).unionByName(empty.select(*names))


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One document of each component, that with the smallest id; null ids stay.

    Rows of one id with different texts are told apart: each stays or goes with its own component. If several of them are first in one
    component, the text with the least hash stays; of rows with one id and text, that with the least hash of all columns.
    """
    found = stage(grouped_rows(docs, width, percent).filter("doc_id is not null"))
    first = found.filter("component_id = doc_id and component is not null").select("doc_id", "component", "th").distinct()
    tied = stage(
        first.groupBy("doc_id", "component").agg(F.min("th").alias("__least"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    )
    gone = found.filter("component_id != doc_id").select("doc_id", "th")
    if not tied.isEmpty():
        gone = gone.unionByName(first.join(tied, ["doc_id", "component"]).filter("th != __least").select("doc_id", "th"))
    gone = stage(gone.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    match = (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    kept = docs.join(checked_broadcast(gone), match, "left_anti")
    repeated = stage(found.groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")))
    if repeated.isEmpty():
        return kept
    again = kept.join(checked_broadcast(repeated), match, "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    chosen = again.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row"))
    return kept.join(checked_broadcast(repeated), match, "left_anti").unionByName(chosen.select("__row.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))
