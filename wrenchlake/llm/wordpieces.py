"""Token ids of whole texts by a public word-level tokenizer, with each distinct word encoded once per worker.

The tokenizer drops white space and never looks across it, so the ids of a text are those of its blank-separated chunks
in a row. Chunks not met before are encoded together by the tokenizer itself, then kept for the worker's later tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np

#: Chunks kept per Python worker; beyond that only those of the current batch stay.
KEPT_CHUNKS = 400_000

_SIMPLE = re.compile(r"[!-~]+\Z")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: How the tokenizer cuts plain ASCII (its pattern, restricted to that range).
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def split_chunks(text: str | None) -> list[str]:
    """Chunks between ASCII white space; anything rarer stays inside its chunk and is left to the tokenizer."""
    return [x.decode() for x in (text or "").encode().split()]


class WordPieces:
    """Ids of chunks as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Make sure all these chunks are known."""
        wanted = set(chunks)
        if len(self.known) > KEPT_CHUNKS:
            self.known = {c: self.known[c] for c in wanted if c in self.known}
        new = wanted.difference(self.known)
        # Words of ASCII letters only are by far the most, and are told by two built-in calls.
        plain = [c for c in new if c.isascii() and c.isalpha()]
        counts, other = [1] * len(plain), []
        for chunk in new.difference(plain):
            if _LETTERS.match(chunk):
                plain.append(chunk)
                counts.append(1)
            elif _SIMPLE.match(chunk) and "<|" not in chunk:
                plain.append(chunk)
                counts.append(len(_PRETOKEN.findall(chunk.lower())))
            else:
                other.append(chunk)
        for at in range(0, len(plain), 20_000):
            other += self._together(plain[at : at + 20_000], counts[at : at + 20_000])
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[chunk] = np.array(found.ids, "<u4").tobytes()
        return self.known

    def _together(self, chunks: Sequence[str], counts: Sequence[int]) -> Sequence[str]:
        """Encode the chunks as one text; those for which the number of words does not come out are returned."""
        ids = np.array(
            self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4"
        )
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != sum(counts):
            return chunks
        stops = ends[np.cumsum(counts) - 1].tolist()
        raw, known, start = ids.tobytes(), self.known, 0
        for chunk, stop in zip(chunks, stops):
            known[chunk] = raw[4 * start : 4 * stop]
            start = stop
        return []


def for_worker(path: str, memory: dict) -> WordPieces:
    """The worker's own instance; `memory` is what lives as long as the worker."""
    if path not in memory:
        memory[path] = WordPieces(path)
    return memory[path]
