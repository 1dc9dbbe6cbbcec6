"""Hard negatives by spanning-tree bounds against brute force and against the SQL."""

from __future__ import annotations

import math

import numpy as np

from tests.llm.conftest import read, records
from tests.oracle import connect, differences
from wrenchlake.llm import hard_negatives

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * x) if abs(x) < 2**60 else 256 * int(x) for x in vector], label))
    last = 10**30
    out = []
    for k, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        others = [(sum(x * y for x, y in zip(a, v)), i, same == label) for j, (i, v, same) in enumerate(kept) if j != k and len(v) == len(a)]
        others.sort(key=lambda r: (-r[0], last if r[1] is None else r[1]))
        for score, positive, _ in [r for r in others if r[2]][:5]:
            window = [r for r in others if not r[2] and 30 * score <= 100 * r[0] <= 90 * score][:10]
            for rank, (found, negative, _) in enumerate(window, 1):
                fit = [x if -(2**63) <= x < 2**63 else None for x in (score, found)]
                out.append((anchor, positive, rank, negative, *fit))
    return sorted(out, key=repr)


def mined(df):
    return sorted((tuple(r[n] for n in NAMES) for r in records(df)), key=repr)


def clustered(n=900, dim=12):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(9, dim))
    rows = []
    for k in range(n):
        c = int(rng.integers(9))
        rows.append((k, (centers[c] + rng.normal(size=dim) * 0.3).tolist(), c if rng.random() < 0.6 else int(rng.integers(10))))
    return rows


ODD = [
    (1000, [1.0] * 12, 3), (1000, [1.0] * 12, 3), (1000, [0.5] * 12, 2), (1001, [1.0] * 12, 3), (None, [1.0] * 12, 3), (None, [0.9] * 12, 4), (1002, None, 3),
    (1003, [float("nan")] + [0.0] * 11, 1), (1004, [None] * 12, 1), (1005, [1.0] * 12, None), (1100, [1.0, 2.0], 1), (1101, [1.0, 1.5], 1), (1102, [0.7, 0.8], 2),
    (1200, [], 1), (1201, [], 1), (1202, [], 2), (1300, [0.0] * 12, 5), (1301, [float("inf")] * 12, 5), (1400, [1e12] * 3, 1), (1401, [1e12, 1e12, 9e11], 1), (1402, [5e11] * 3, 2),
    (1403, [7e11] * 3, 2), (1500, [1e-3, 1.0, 1.0, 1.0], 1), (1501, [1.0, 1.0, 1.0, 0.999], 1), (1502, [0.6, 0.6, 0.6, 0.6], 3), (1503, [0.6, 0.6, 0.6, 0.6], 3), (1601, [-0.5] * 12, 8),
]


def test_odd_rows(make, monkeypatch):
    rows = clustered(300) + ODD
    vectors = make([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, uid string, slot int").repartition(3)
    assert mined(hard_negatives.hard_negatives(vectors)) == brute(rows)
    empty = make([], "vec_id long, embedding array<float>, label int")
    assert mined(hard_negatives.hard_negatives(empty)) == []
    alone = make([(100, [1.0], 1), (200, [2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert mined(hard_negatives.hard_negatives(alone)) == []


def test_small_blocks_chunks_and_rounds(make, monkeypatch):
    rows = clustered(700)
    for name, value in (("BLOCK_ANCHORS", 3), ("CHUNK_ROWS", 50), ("TILE_PAIRS", 64), ("ROUND_BYTES", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    vectors = make(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    assert mined(hard_negatives.hard_negatives(vectors)) == brute(rows)


def test_close_anchors_save_most_scores():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(10, 16)) * 3
    label = np.arange(2000) % 10
    whole = hard_negatives.whole_numbers(centers[label] + rng.normal(size=(2000, 16)) * 0.001)
    table = hard_negatives._table(np.arange(2000), np.arange(2000), label, centers[label] + rng.normal(size=(2000, 16)) * 0.001)
    anchors = hard_negatives.Table(*[x[:50] for x in table])
    block = hard_negatives.Block(anchors, np.arange(50), [-math.inf] * 50, [math.inf] * 50, True, 5)
    for at in range(0, 2000, 200):
        block.meet(hard_negatives.Table(*[x[at : at + 200] for x in table]))
    assert block.scored < 50 * 2000 / 5
    assert whole.dtype == np.float64


def test_a_table_against_its_sql_and_brute_force(spark, small):
    found = hard_negatives.op13_hard_negatives(spark, small)
    assert differences(found, connect(small), hard_negatives.SQL) is None
    assert mined(found) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in read(small, "embeddings")])
