"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text hashed at a time; a longer text is a batch of its own.
BATCH_BYTES = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin among them (one entry more than texts)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    term = _BYTE[raw] * _powers(_BASE, len(raw))
    upto = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(term)))
    hashes = mixed((upto[stops] - upto[starts]) * _powers(_INVERSE, len(raw))[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def shingle_sets(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `width`-word shingles; of a shorter text, its whole sequence."""
    words, bounds = word_hashes(texts)
    full = len(words) - width + 1
    rolled = np.zeros(max(full, 0), np.uint64)
    for k in range(width if full > 0 else 0):
        rolled += words[k : k + full] * _STEP[k]
    rolled = mixed(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            short = (words[lo:hi] * _STEP[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches_of(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) texts in runs of bounded size."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().lower()
        if held and size + len(raw) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held
