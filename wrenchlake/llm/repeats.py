"""Removal of repeated 100-byte strings by prefix-free parsing.

**Parse.** A rolling hash of `GRAM` bytes runs over each text. Every run of `SPAN` consecutive hashes chooses its leftmost least one as a trigger,
so triggers depend on the bytes around them alone and are at most `SPAN` apart. A phrase goes from a trigger to the
end of the next trigger's gram; phrases overlap by a gram, which makes them prefix-free. 2 * SPAN + GRAM <= 100, so the trigger chosen by the
first run in a 100-byte window and the phrase from there lie inside the window, and equal windows have the same.

**Dictionary.** Windows are dealt by that phrase. The neighbouring windows with one trigger form a context: the bytes from which all of them
can be read. For each phrase the parse gives its contexts; three cases settle nearly all text without looking at bytes again:
a phrase met once has no repeated window; a context met before is repeated as a whole; a phrase met in one context only has no other
repeats than those. In highly repetitive text this leaves the seams: contexts that share a phrase and differ elsewhere.

**Suffix arrays.** The distinct contexts at the seams are written out once, dealt by phrase. A suffix array of their windows, built by prefix doubling
over the bytes, puts equal windows side by side; the one that comes first in the corpus (document, then start) stays, the rest are repeats.
The state of each context in the parse and the repeats from the suffix arrays go back to their documents, where runs are united.

Texts equal as a whole are settled first by their SHA-256: all but the first go. Phrases are compared by 32 bits of hash beside those that deal
them (a collision only costs a look at the bytes), contexts of one phrase by 64 more. Work per task is bounded by `PART_BYTES`, and the contexts
that meet in one suffix array by `PHRASE_BYTES`: of a phrase with more, the windows are dealt one by one, by 128 bits of hash of
their bytes, and each is told whether it is the first. Phrases that a third of the texts share are so spread over all tasks.

Null text is empty. Texts under 100 bytes lose nothing. Repeated rows: the first stays. Of different texts with one id, that with the smaller hash
comes first; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import (
    WORD,
    arrow_pass,
    checked_broadcast,
    documents,
    groups,
    join_counted,
    pa_schema,
    sliced,
    stage_text,
)
from wrenchlake.llm.hashing import mixed
from wrenchlake.session import stage

WINDOW = 100
GRAM, SPAN = 12, 44
#: Bytes of text whose parse meets in one task, and bytes parsed together.
PART_BYTES = 8_000_000
BATCH_BYTES = 1_000_000
#: Bytes of contexts of one phrase that are compared in one suffix array; those of a longer one are dealt by window.
PHRASE_BYTES = 2_000_000
#: Replies broadcast instead of shuffled beside the texts, if their number is shown to be at most this.
BROADCAST_REPLIES = 500_000

REPEATED, LATER, SEAM = 1, 2, 4

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
#: Null ids sort after all others.
_NULL_ID = 2**63 - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slide(x: np.ndarray, length: int, best) -> np.ndarray:
    """`best` over each run of `length` neighbours, by doubling; one entry per full run."""
    size = 1
    while size * 2 <= length:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = length - size
    return best(x[:-rest], x[rest:]) if rest else x


class Parse:
    """Triggers, phrases and contexts of several texts of at least WINDOW bytes each.

    Per context: `doc`, its first window `low` and last window `high` (starts within the text), `phrase` and `context` hashes,
    and the start of the first run that chose the phrase's second trigger.
    """

    def __init__(self, texts: Sequence[bytes]) -> None:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        upto = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTE[raw] * _powers(_BASE, n))))
        inverse = _powers(_INVERSE, n)

        def hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return mixed((upto[high] - upto[low]) * inverse[low] + (high - low).astype(np.uint64))

        grams = n - GRAM + 1
        rolled = mixed((upto[GRAM:] - upto[:grams]) * inverse[:grams])
        # Hash above position: the least value of a run is its leftmost least hash.
        rolled = (rolled & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        chosen = (_slide(rolled, SPAN, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        run_doc = np.searchsorted(ends, np.arange(len(chosen)), side="right")
        run = np.flatnonzero(np.arange(len(chosen)) <= ends[run_doc] - GRAM - SPAN + 1)  # runs within one text
        chosen, run_doc = chosen[run], run_doc[run]
        new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (run_doc[1:] != run_doc[:-1])))
        trigger, doc, first_run = chosen[new], run_doc[new], run[new]
        last_run = np.concatenate((run[:-1][new[1:]], run[-1:]))
        same = doc[1:] == doc[:-1]
        left, right = trigger[:-1][same], trigger[1:][same]
        self.doc = doc[:-1][same]
        low = first_run[:-1][same]
        high = np.minimum(last_run[:-1][same], ends[self.doc] - WINDOW)
        self.next_run = first_run[1:][same] - starts[self.doc]
        self.phrase = hashed(left, right + GRAM)
        # Near the end of a text a phrase may begin after the last window; it has no context of its own.
        self.filled = high >= low
        self.context = np.where(self.filled, hashed(low, np.minimum(np.maximum(high, low) + WINDOW, n)), np.uint64(0))
        self.low, self.high = low - starts[self.doc], high - starts[self.doc]
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def _runs(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, n in enumerate(lengths):
        if i > low and size + n > BATCH_BYTES:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(lengths):
        yield low, len(lengths)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(_NULL_ID).to_numpy()


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def parsed_items(texts: DataFrame, parts: int) -> DataFrame:
    """The parse as blobs: per run of texts and part, the documents (id, hash, items each) and their items (phrase, context).

    32 bits of a phrase's hash beside those that chose the part are enough, as contexts of one phrase are compared by 64 of their own.
    """
    schema = "part int, ids binary, hashes binary, counts binary, phrases binary, contexts binary"
    types = pa_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [t.encode() for t in _column(batch, "text").to_pylist()]
            ids, hashes = _ids(batch), _column(batch, "th").to_numpy()
            for lo, hi in _runs([len(t) for t in raw]):
                p = Parse(raw[lo:hi])
                part = part_of(p.phrase, parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                rows: dict[str, list] = {f.name: [] for f in types}
                for k in np.flatnonzero(np.diff(edges)):
                    at = order[edges[k] : edges[k + 1]]
                    docs, counts = np.unique(p.doc[at], return_counts=True)
                    rows["part"].append(int(k))
                    rows["ids"].append(ids[lo:hi][docs].tobytes())
                    rows["hashes"].append(hashes[lo:hi][docs].tobytes())
                    rows["counts"].append(counts.astype(np.uint32).tobytes())
                    rows["phrases"].append(p.phrase[at].astype(np.uint32).tobytes())
                    rows["contexts"].append(p.context[at].tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=types)

    return texts.select("doc_id", "th", "text").mapInArrow(run, schema)


def part_of(phrase: np.ndarray, parts: int) -> np.ndarray:
    return ((phrase >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def item_states(items: DataFrame) -> DataFrame:
    """(doc_id, th, state) for the items whose state is not 0.

    Above its three bits the state has the part (32 bits up) and the item's number among those of its document in that part.
    """
    schema = "doc_id long, th long, state long"
    types = pa_schema(items.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["part"]):
            read = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
            ids, hashes = read("ids", np.int64), read("hashes", np.int64)
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((hashes, ids))] = np.arange(len(ids))
            counts = read("counts", np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), counts)
            index = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            phrase, part = read("phrases", np.uint32), group["part"][0].as_py()
            context = read("contexts", np.uint64)
            # Stable: items of one document stay in their order.
            order = np.lexsort((index, place[doc], context, phrase))
            new_phrase = np.concatenate(([True], phrase[order][1:] != phrase[order][:-1]))
            new_context = new_phrase | np.concatenate(([True], context[order][1:] != context[order][:-1]))
            of_phrase = np.cumsum(new_phrase) - 1
            met = np.bincount(of_phrase)[of_phrase]
            contexts = np.bincount(of_phrase, weights=new_context)[of_phrase]
            state = np.where(met > 1, REPEATED, 0) | np.where(new_context, 0, LATER)
            state |= np.where(new_context & (contexts > 1), SEAM, 0)
            told = order[state > 0]
            out = [ids[doc[told]], hashes[doc[told]], (part << 35) | (index[told] << 3) | state[state > 0]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=types)

    return items.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _states_of(p: Parse, doc: int, told: Sequence[int] | None, parts: int) -> np.ndarray:
    own = slice(p.bounds[doc], p.bounds[doc + 1])
    out = np.zeros(own.stop - own.start, np.uint8)
    if told is not None and len(told):
        values = np.asarray(told, np.int64)
        part = part_of(p.phrase[own], parts)
        order = np.argsort(part, kind="stable")
        first = np.searchsorted(part[order], values >> 35)
        out[order[first + ((values >> 3) & 0xFFFFFFFF)]] = values & 7
    return out


def seams(texts: DataFrame, parts: int) -> DataFrame:
    """Contexts whose windows must be compared: (phrase, doc_id, th, low, windows, bytes)."""
    schema = "phrase long, doc_id long, th long, low long, windows int, bytes binary"
    types = pa_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [t.encode() for t in _column(batch, "text").to_pylist()]
            ids, hashes, told = _ids(batch), _column(batch, "th").to_numpy(), _column(batch, "states").to_pylist()
            for lo, hi in _runs([len(t) for t in raw]):
                p = Parse(raw[lo:hi])
                rows: dict[str, list] = {f.name: [] for f in types}
                for d in range(hi - lo):
                    own = slice(p.bounds[d], p.bounds[d + 1])
                    state = _states_of(p, d, told[lo + d], parts)
                    # The windows of a context hold further phrases to their right; one met only once ends the search.
                    count = len(state)
                    bad = np.where(state & REPEATED, count, np.arange(count))
                    bad = np.minimum.accumulate(bad[::-1])[::-1]
                    # Only triggers chosen by runs inside a window are sure to be the same in its copies.
                    limit = np.concatenate((p.next_run[own], [2**62]))[bad] - (WINDOW - GRAM - SPAN + 2)
                    high = np.minimum(p.high[own], limit)
                    low = p.low[own]
                    for k in np.flatnonzero((state & SEAM > 0) & (high >= low)):
                        a, b = int(low[k]), int(high[k])
                        row = (p.phrase[own][k].astype(np.int64), ids[lo + d], hashes[lo + d], a, b - a + 1)
                        for name, value in zip(rows, row):
                            rows[name].append(int(value))
                        rows["bytes"].append(raw[lo + d][a : b + WINDOW])
                yield pa.RecordBatch.from_pydict(rows, schema=types)

    return texts.mapInArrow(run, schema)


def suffix_ranks(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the WINDOW-byte strings at `starts`, equal for equal strings, by prefix doubling.

    Ranks are kept for every position that a longer prefix needs; positions near the end are never asked for.
    """
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(WINDOW, np.uint8)))
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | padded[k : k + n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)

    def joined(x: np.ndarray, shift: int) -> np.ndarray:
        right = np.concatenate((x[shift:], np.zeros(shift, np.int64)))
        return np.unique((x << np.int64(32)) | right, return_inverse=True)[1].astype(np.int64)

    size = 8
    while size * 2 <= WINDOW:
        rank = joined(rank, size)
        size *= 2
    final = (rank[starts] << np.int64(32)) | rank[starts + WINDOW - size]
    return np.unique(final, return_inverse=True)[1]


def seam_repeats(contexts: DataFrame) -> DataFrame:
    """(doc_id, th, low, mask) for contexts with repeated windows; the mask has a byte per window."""
    schema = "doc_id long, th long, low long, mask binary"
    types = pa_schema(contexts.sparkSession, schema)

    def judge(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        pieces = t["bytes"].to_pylist()
        lengths = np.array([len(x) for x in pieces], np.int64)
        ids, hashes, lows = (t[c].to_numpy() for c in ("doc_id", "th", "low"))
        windows = t["windows"].to_numpy().astype(np.int64)
        base = np.repeat(np.cumsum(lengths) - lengths, windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = suffix_ranks(np.frombuffer(b"".join(pieces), np.uint8), base + inner)
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((lows, hashes, ids))] = np.arange(len(ids))
        order = np.lexsort((inner, np.repeat(place, windows), rank))
        repeated = np.zeros(len(rank), np.uint8)
        repeated[order[1:]] = rank[order][1:] == rank[order][:-1]
        cuts = np.cumsum(windows)[:-1]
        masks = np.split(repeated, cuts)
        hit = [k for k, m in enumerate(masks) if m.any()]
        out = [ids[hit], hashes[hit], lows[hit], [masks[k].tobytes() for k in hit]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, types)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for group in groups(batches, ["phrase"]):
            held.append(group)
            size += group["bytes"].nbytes
            if size > 2 * BATCH_BYTES:
                yield judge(held)
                held, size = [], 0
        if held:
            yield judge(held)

    return contexts.repartition("phrase").sortWithinPartitions("phrase").mapInArrow(run, schema)


def window_repeats(contexts: DataFrame) -> DataFrame:
    """The same as `seam_repeats`, with a row per repeated window, for contexts of phrases with very many.

    Windows are dealt by their bytes' hash and combined to their first place before they move, so the contexts of a phrase never meet.
    """
    schema = "doc_id long, th long, low long, window binary"
    types = pa_schema(contexts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = _column(batch, "windows").to_numpy().astype(np.int64)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = [
                hashlib.blake2b(raw[k : k + WINDOW], digest_size=16).digest()
                for raw, n in zip(_column(batch, "bytes").to_pylist(), counts.tolist())
                for k in range(n)
            ]
            doc, th, low = (np.repeat(_column(batch, n).to_numpy(), counts) for n in ("doc_id", "th", "low"))
            columns = [doc, th, low + inner, hashes]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    windows = stage(contexts.mapInArrow(run, schema))
    place = F.struct("doc_id", "th", "low")
    firsts = windows.groupBy("window").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("times"))
    told = join_counted(windows, stage(firsts.filter("times > 1")), "window", "times", windows.count())
    again = told.filter(F.col("__first").isNotNull() & (place != F.col("__first")))
    return again.select("doc_id", "th", "low", F.lit(b"\x01").alias("mask"))


def compared(contexts: DataFrame) -> DataFrame:
    """Repeats among staged contexts: phrases by suffix arrays, those of more than `PHRASE_BYTES` by window."""
    sizes = contexts.groupBy("phrase").agg(F.sum(F.octet_length("bytes")).alias("__size"))
    large = stage(sizes.filter(F.col("__size") > PHRASE_BYTES).select(F.col("phrase").alias("__p")))
    if large.isEmpty():
        return seam_repeats(contexts)
    large, match = checked_broadcast(large), F.col("phrase") == F.col("__p")
    usual = seam_repeats(contexts.join(large, match, "left_anti"))
    return usual.unionByName(window_repeats(contexts.join(large, match, "left_semi")))


def removed_bytes(
    p: Parse, doc: int, told: Sequence[int] | None, extra: Sequence[dict] | None, parts: int
) -> np.ndarray:
    """Which bytes of the document go."""
    own = slice(p.bounds[doc], p.bounds[doc + 1])
    state = _states_of(p, doc, told, parts)
    size = int(p.high[own].max(initial=0)) + 2 * WINDOW + GRAM
    step = np.zeros(size + 1, np.int64)
    later = (state & LATER > 0) & p.filled[own]
    np.add.at(step, p.low[own][later], 1)
    np.add.at(step, p.high[own][later] + WINDOW, -1)
    for x in extra or ():
        starts = np.flatnonzero(np.frombuffer(x["mask"], np.uint8)) + x["low"]
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step) > 0


def cut_repeats(texts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, th, n_removed, n_spans, sha, kept) for texts with states.

    sha is of the remaining bytes; kept is these as text, without the parts of characters that were cut apart.
    """
    schema = "doc_id long, th long, n_removed long, n_spans long, sha string, kept string"

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        raw = [t.encode() for t in _column(batch, "text").to_pylist()]
        told, extra = _column(batch, "states").to_pylist(), _column(batch, "extra").to_pylist()
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "sha": [], "kept": []}
        for lo, hi in _runs([len(t) for t in raw]):
            p = Parse(raw[lo:hi])
            for d in range(hi - lo):
                text = np.frombuffer(raw[lo + d], np.uint8)
                gone = removed_bytes(p, d, told[lo + d], extra[lo + d], parts)[: len(text)]
                gone = np.concatenate((gone, np.zeros(len(text) - len(gone), bool)))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                rest = text[~gone].tobytes()
                out["sha"].append(hashlib.sha256(rest).hexdigest())
                out["kept"].append(rest.decode("utf-8", "ignore"))
        return out | {"doc_id": _ids(batch), "th": _column(batch, "th")}

    return arrow_pass(texts, rows, schema)


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("th")]


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All rows (doc_id, th, digest, n_bytes, first: whether this row holds the text's first occurrence), staged; and for
    the first rows of at least WINDOW bytes that have something to look at: doc_id, th, text, states, extra; and the parts."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = stage(
        keyed.select(*_key(), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    )
    owners = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies")))
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    judged = join_counted(rows, owners.filter("copies > 1"), "digest", "copies", total[0])
    judged = stage(judged.withColumn("first", F.coalesce(F.col("owner") == F.col("doc_id"), F.lit(True))).drop("owner"))
    copies = stage(judged.filter("not first").select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    texts = keyed.filter(F.octet_length("text") >= WINDOW).select(*_key(), "text")
    match = (F.col("doc_id") == F.col("__d")) & (F.col("th") == F.col("__t"))
    texts = texts.join(checked_broadcast(copies), match, "left_anti")
    if not judged.filter("first").groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "th"])
    parts = max(8, -(-total[1] // PART_BYTES))
    told = stage(
        item_states(parsed_items(texts, parts))
        .groupBy("doc_id", "th")
        .agg(F.collect_list("state").alias("states"))
    )
    right = told.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "states")
    # Texts without any state are left out before the others move.
    asked = texts.join(checked_broadcast(right.select("__d", "__t")), match, "left_semi")
    held = stage_text(asked.join(_broadcast_replies(right, "states"), match).drop("__d", "__t"))
    found = stage(
        compared(stage_text(seams(held, parts)))
        .groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
        .agg(F.collect_list(F.struct("low", "mask")).alias("extra"))
    )
    return judged, held.join(_broadcast_replies(found, "extra"), match, "left").drop("__d", "__t"), parts


def _broadcast_replies(replies: DataFrame, column: str) -> DataFrame:
    """Replies with the hint to broadcast them if their number, added up, allows that."""
    number = replies.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    return F.broadcast(replies) if number <= BROADCAST_REPLIES else replies


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    judged, held, parts = find_repeats(docs)
    cut = stage(cut_repeats(held, parts).drop("kept"))
    right = cut.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "n_removed", "n_spans", "sha")
    match = (F.col("doc_id") == F.col("__d")) & (F.col("th") == F.col("__t"))
    out = judged.join(right, match, "left")
    # Of equal rows with one id, the first keeps what the text keeps.
    repeated = judged.groupBy("doc_id", "digest").count().filter("count > 1")
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(0)))
        out = out.withColumn("first", F.col("first") & (number == 1))
    copy = ~F.col("first") & (F.col("n_bytes") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of `text` (n_chars follows if there is such a column).

    Texts that are copies as a whole go, and so does a text of which only white space is left.
    """
    names = docs.columns
    judged, held, parts = find_repeats(docs)
    cut = cut_repeats(held, parts).filter("n_removed > 0")
    cut = stage(cut.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("kept").alias("__kept")))
    gone = judged.filter(~F.col("first") & (F.col("n_bytes") >= WINDOW))
    gone = stage(gone.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    match = (F.col("__doc") == F.col("__d")) & (F.col("__th") == F.col("__t"))
    keyed = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn(
        "__th", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    left = keyed.join(checked_broadcast(gone), match, "left_anti")
    if not judged.filter("first").groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        long = F.octet_length(F.coalesce("text", F.lit(""))) >= WINDOW
        left = left.filter(long).dropDuplicates(["__doc", "__th"]).unionByName(left.filter(~long | long.isNull()))
    out = left.join(cut, match, "left").filter(F.col("__kept").isNull() | F.col("__kept").rlike(WORD))
    if "n_chars" in names:
        changed = F.col("__kept").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce("__kept", "text")).select(*names)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir))
