"""Token ids of a public piece model by merge rounds over flat arrays, and the texts back from the ids.

The model merges the adjacent pair whose piece has the best score, again and again, the leftmost of equals first. Here the symbols
of all new words of a batch lie in one numpy array. Each round finds, per word, the least rank of a pair (a segmented minimum), merges
all its pairs at once, the leftmost of overlapping ones, and closes the gaps; words without a pair leave. Merging all at once gives what
one at a time gives, unless the new piece could at once be part of a pair that ranks no later: for those pieces, found from the
vocabulary when it is loaded, a round merges the leftmost pair of a word only. No piece has a word mark after another character, so a text may
be cut before each run of marks; the constructor refuses a model where that, or the byte fallback, does not hold. A word of over LONG symbols
goes through an agenda of pairs instead, with the same result, as rounds would cost their number times its length.

Normalisation is that of the model: blanks become marks, one mark is put in front of a text, nothing else changes. A character without a
piece becomes its UTF-8 bytes. Ids to text: pieces in a row, marks as blanks, without the mark in front; each byte that is no part of a
character becomes U+FFFD; begin and end ids give nothing, the unknown id gives the model's sign.

Results for odd rows: null or empty text has no ids (null ids decode to the empty text); very long texts are worked on whole; repeated rows and equal or null
doc_ids are rows of their own; an empty table gives an empty table; other columns stay as they are, those named like the result are replaced.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm.chunks import Chunks, Remembered, flat, in_slices, numbered_chunks
from wrenchlake.llm.common import documents, pa_schema, worker_memory

MARK = "▁"
#: A word of more symbols than this is merged by an agenda.
LONG = 2000
#: Symbols merged in the same rounds.
ROUND_SYMBOLS = 2_000_000
#: Ids turned into text at a time; a longer list is a batch of its own.
BATCH_IDS = 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: symbols of characters, ranks of pairs, and what each id stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in ids]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in ids]
        normal = {names[i]: i for i in ids if not special[i]}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
        if (self.byte_ids < 0).any() or any(MARK in piece.lstrip(MARK) for piece in normal) or sp.encode(" a", out_type=str)[0][:1] != MARK:
            raise ValueError("the model must fall back to bytes and have marks at the front of pieces only")
        symbols = dict(normal)
        for char in sorted({c for piece in normal for c in piece}):
            symbols.setdefault(char, len(names) + len(symbols))
        self.base = max(symbols.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int32)
        for char, symbol in symbols.items():
            if len(char) == 1:
                self.of_char[ord(char)] = symbol
        score = np.zeros(self.base)
        for piece, i in normal.items():
            score[i] = sp.get_score(i)
        # Equal scores are equal ranks: then the place decides.
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs = sorted(
            (symbols[piece[:k]] * self.base + symbols[piece[k:]], i)
            for piece, i in normal.items()
            for k in range(1, len(piece))
            if piece[:k] in symbols and piece[k:] in symbols
        )
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int32)
        self.alone = np.zeros(self.base, bool)
        for side in (self.keys // self.base, self.keys % self.base):
            self.alone[side[self.rank[self.made] <= self.rank[side]]] = True
        surface = [
            (b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            if special[i] and not sp.is_byte(i)
            else bytes([int(names[i][1:-1], 16)])
            if special[i]
            else names[i].replace(MARK, " ").encode()
            for i in ids
        ]
        self.surface = pa.array(surface, pa.large_binary())
        self.blank_front = np.array([not special[i] and names[i].startswith(MARK) for i in ids])
        self.is_control = np.array([sp.is_control(i) for i in ids])
        self.words = Remembered(self.encode_words)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode_words(self, words: Sequence[str]) -> Iterator[bytes]:
        """Ids of each word as little-endian 32-bit bytes; words hold blanks for marks."""
        low = 0
        while low < len(words):
            high, size = low, 0
            while high < len(words) and (high == low or size + len(words[high]) <= ROUND_SYMBOLS):
                size += len(words[high])
                high += 1
            yield from self._encode_some(words[low:high])
            low = high

    def _encode_some(self, words: Sequence[str]) -> Iterator[bytes]:
        code = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        found = self.of_char[code]
        symbols = np.where(found >= 0, found, -1 - code)
        word = np.repeat(np.arange(len(words)), size)
        long = np.repeat(size > LONG, size)
        done = [self._rounds(symbols[~long], word[~long])]
        ends = np.cumsum(size)
        for w in np.flatnonzero(size > LONG).tolist():
            merged = self._agenda(symbols[ends[w] - size[w] : ends[w]])
            done.append((merged, np.full(len(merged), w)))
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        ids, word = self._with_bytes(symbols[order], word[order])
        raw = ids.astype("<i4").tobytes()
        bounds = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        return (raw[a:b] for a, b in zip(bounds, bounds[1:]))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.iinfo(np.int32).max
        finished: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs_at(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at + 1 < len(symbols))]
            at = at[word[at] == word[at + 1]]
            piece[at] = self.pair(symbols[at], symbols[at + 1])

        piece = np.full(len(symbols), -1, np.int64)
        pairs_at(np.arange(len(symbols)))
        while len(symbols):
            rank = np.where(piece >= 0, self.rank[piece], none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            over = least == none
            if over.any():
                out = np.repeat(over, size)
                finished.append((symbols[out], word[out]))
                symbols, word, piece, rank = symbols[~out], word[~out], piece[~out], rank[~out]
                least, size = least[~over], size[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            w = word[at]
            head = np.append(True, w[1:] != w[:-1])
            # A piece that may be extended at once, or pairs of one rank that make different pieces: the leftmost only.
            single = self.alone[piece[at]]
            one_by_one = np.logical_or.reduceat(single, np.flatnonzero(head)) if single.any() else np.zeros(head.sum(), bool)
            at, w, head = (x[head | ~one_by_one[np.cumsum(head) - 1]] for x in (at, w, head))
            # Of pairs that overlap in a row, the first, third and so on.
            fresh = np.append(True, (at[1:] != at[:-1] + 1) | (w[1:] != w[:-1]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # The pair after a merged one begins now at the merged symbol.
            symbols, word, piece = symbols[keep], word[keep], piece[keep]
            at = at - np.arange(len(at))
            piece[at] = -1
            before = at[at > 0] - 1
            piece[before] = -1
            pairs_at(np.unique(np.concatenate((before, at))))
        if not finished:
            return symbols, word
        return np.concatenate([s for s, _ in finished]), np.concatenate([w for _, w in finished])

    def _agenda(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: pairs from a heap by rank and place; pairs that changed meanwhile are passed over."""
        held = symbols.tolist()
        n = len(held)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.pair(symbols[:-1], symbols[1:])
        ranks = self.rank.tolist()
        known = dict(zip(self.keys.tolist(), self.made.tolist()))
        agenda = [(ranks[p], i, p, held[i], held[i + 1]) for i, p in enumerate(made.tolist()) if p >= 0]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, left, right = heapq.heappop(agenda)
            j = after[i]
            if held[i] != left or j >= n or held[j] != right:
                continue
            held[i], held[j] = piece, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and held[a] >= 0 and held[b] >= 0:
                    found = known.get(held[a] * self.base + held[b])
                    if found is not None:
                        heapq.heappush(agenda, (ranks[found], a, found, held[a], held[b]))
        return np.array([s for s in held if s is not None], np.int64)

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the ids of their bytes."""
        lost = np.flatnonzero((symbols < 0) | (symbols >= len(self.surface)))
        if not len(lost):
            return symbols, word
        chars = {s: chr(-1 - s) for s in np.unique(symbols[lost]).tolist() if s < 0}
        if len(chars) < len(np.unique(symbols[lost])):
            back = {int(self.of_char[c]): chr(c) for c in np.flatnonzero(self.of_char >= len(self.surface)).tolist()}
            chars |= back
        spelled = {s: self.byte_ids[list(c.encode())] for s, c in chars.items()}
        size = np.ones(len(symbols), np.int64)
        parts = [spelled[s] for s in symbols[lost].tolist()]
        size[lost] = [len(p) for p in parts]
        out = np.repeat(symbols, size)
        at = np.repeat(np.isin(np.arange(len(symbols)), lost), size)
        out[at] = np.concatenate(parts)
        return out, np.repeat(word, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        raw, offsets = flat(pc.binary_join_element_wise(front, texts, ""))
        blank = raw == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        chunks: Chunks = numbered_chunks(raw, starts, np.searchsorted(starts, offsets))
        found, bounds = self.words.of(chunks)
        return found.view("<i4"), bounds // 4

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each list of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.surface)):
            raise ValueError("an id is not of this model")
        taken = self.surface.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2])[: ends[-1]] if len(ids) else memoryview(b"")
        low, high = ends[bounds[:-1]], ends[bounds[1:]]
        # The first id that is no begin or end loses its mark.
        shown = np.append(np.flatnonzero(~self.is_control[ids]), len(ids))
        first = shown[np.searchsorted(shown, bounds[:-1])]
        has = first < bounds[1:]
        cut = np.zeros(len(low), np.int64)
        cut[has] = self.blank_front[ids[first[has]]]
        return pa.array([_readable(bytes(data[a:b])) for a, b in zip((low + cut).tolist(), high.tolist())], pa.string())


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _readable(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        codecs.register_error("wrenchlake_each_byte", _each_byte)
        return raw.decode(errors="wrenchlake_each_byte")


def _pieces(path: str) -> Pieces:
    memory = worker_memory("merge_rounds")
    if path not in memory:
        memory[path] = Pieces(path)
    return memory[path]


def _replace(df: DataFrame, schema: str, column: str, dropped: str | None = None) -> tuple[str, pa.Schema, list[str]]:
    rest = [f for f in df.schema.fields if f.name not in (column, dropped)]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{column}` {schema}"])
    return ddl, pa_schema(df.sparkSession, ddl), [f.name for f in rest]


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """The table with the text column replaced by the list of its token ids."""
    path = model or default_model()
    ddl, schema, rest = _replace(docs, "array<int>", ids, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            for part in in_slices(batch, text):
                values, bounds = pieces.encode(part.column(part.schema.get_field_index(text)))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
                kept = [part.column(part.schema.get_field_index(n)) for n in rest]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*kept, lists], schema)], schema=schema)

    return docs.mapInArrow(run, ddl)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None) -> DataFrame:
    """The table with the text of each list of ids added; the ids stay."""
    path = model or default_model()
    ddl, schema, rest = _replace(encoded, "string", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            low = 0
            while low < batch.num_rows:
                high = low + max(1, int(np.searchsorted(np.cumsum(size[low:]), BATCH_IDS, side="right")))
                part, own = batch.slice(low, high - low), lists.slice(low, high - low)
                values = np.asarray(pc.fill_null(own.flatten(), -1), np.int32)
                texts = pieces.decode(values, np.concatenate(([0], np.cumsum(size[low:high]))))
                kept = [part.column(part.schema.get_field_index(n)) for n in rest]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*kept, texts], schema)], schema=schema)
                low = high

    return encoded.mapInArrow(run, ddl)


def op11_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(documents(spark, sf_dir).select("doc_id", "text")))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
