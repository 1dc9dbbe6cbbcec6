"""Token counts of a unigram tokenizer without making the tokens: a count-only Viterbi.

The vocabulary is that of a public piece model; its pieces are ranked by id and weighted by a fixed rule (probability in
proportion to 1 / rank), so nothing is trained. A text is cut at ASCII white space, each chunk gets the word mark in front, and is
segmented on its own. An Aho-Corasick automaton finds all pieces that end at a character; a single pass carries, per
character, the best score and the number of pieces on the best path. The rules are those of the unigram model in the
`tokenizers` library, which the tests compare with: scores are added as doubles from the left; of paths with equal scores the one whose last piece
begins earlier stays; a character that is no piece itself costs the least score minus 10, and counts as its UTF-8 bytes.

Each distinct chunk is segmented once per worker. Null or empty text has 0 tokens. Repeated rows are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wrenchlake.llm.common import arrow_pass, documents, worker_memory

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks kept per Python worker; beyond that only those of the current batch stay.
KEPT_CHUNKS = 500_000
LOOKUP_DOCS = 500


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces with their log probabilities: unknown first, then ranked pieces; byte pieces get the least."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    normal = [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    all_ = math.log(sum(1 / (k + 1) for k in range(len(normal))))
    ranked = [(piece, -math.log(k + 1) - all_) for k, piece in enumerate(normal)]
    least = ranked[-1][1]
    special = [(sp.id_to_piece(sp.unk_id()), least)]
    return special + ranked + [(sp.id_to_piece(i), least) for i in ids if sp.is_byte(i)]


class Counter:
    """Counts pieces and adds up scores per chunk."""

    def __init__(self, pieces: Iterable[tuple[str, float]]) -> None:
        import ahocorasick

        pieces = list(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """Pieces on the best path, and its score."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, matches in enumerate(ends):
            found, pieces, single = -math.inf, 0, False
            matches.sort(reverse=True)  # longest first: equal scores stay with the earliest start
            for length, score in matches:
                candidate = best[end + 1 - length] + score
                if candidate > found:
                    found, pieces = candidate, count[end + 1 - length] + 1
                single = single or length == 1
            if not single:
                candidate = best[end] + self.unknown
                if candidate > found:
                    found, pieces = candidate, count[end] + len(text[end].encode())
            best[end + 1], count[end + 1] = found, pieces
        return count[n], best[n]

    def count_chunk(self, chunk: str) -> tuple[int, float]:
        """A chunk begins with one word mark; a mark inside begins a segment of its own."""
        marked = chunk if chunk.startswith(MARK) else MARK + chunk
        found = [self.segment(MARK + part) for part in marked[1:].split(MARK)]
        return sum(n for n, _ in found), math.fsum(s for _, s in found)

    def learn(self, chunks: Iterable[str]) -> dict[str, tuple[int, float]]:
        wanted = set(chunks)
        if len(self.known) > KEPT_CHUNKS:
            self.known = {c: self.known[c] for c in wanted if c in self.known}
        for chunk in wanted:
            if chunk not in self.known:
                self.known[chunk] = self.count_chunk(chunk)
        return self.known


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, score (log probability of the best segmentation)."""
    model = model or default_model()

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        memory = worker_memory("unigram")
        if model not in memory:
            memory[model] = Counter(vocabulary(model))
        counter = memory[model]
        texts = batch.column(batch.schema.get_field_index("text"))
        out: dict[str, list] = {"n_words": [], "n_tokens": [], "score": []}
        for at in range(0, len(texts), LOOKUP_DOCS):
            cut = [[x.decode() for x in (t or "").encode().split()] for t in texts.slice(at, LOOKUP_DOCS).to_pylist()]
            known = counter.learn(c for chunks in cut for c in chunks)
            for chunks in cut:
                found = [known[c] for c in chunks]
                out["n_words"].append(len(chunks))
                out["n_tokens"].append(sum(n for n, _ in found))
                out["score"].append(math.fsum(s for _, s in found))
        return out | {"doc_id": batch.column(batch.schema.get_field_index("doc_id"))}

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long, score double"
    return arrow_pass(docs.select("doc_id", "text"), rows, schema, "unigram")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
