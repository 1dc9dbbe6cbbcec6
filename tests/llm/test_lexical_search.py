"""The index by length stratum against brute force and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from tests.llm.conftest import records
from tests.oracle import connect, differences
from wrenchlake.llm import lexical_search
from wrenchlake.session import new_shared_folder

_RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _RUN.findall((text or "").translate(_LOWER))


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item_id, rank, i, -score))
    return sorted(out, key=repr)


def searched(spark, docs, items, top=10):
    folder = new_shared_folder(spark)
    lexical_search.build_index(docs, folder)
    found = records(lexical_search.search(spark, folder, items, top))
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=repr)


def test_odd_rows(spark, odd, nothing, make):
    docs = [(r["doc_id"], r["text"]) for r in records(odd)]
    items = [(1, "Word7 AND word12 or"), (1, "Word7 AND word12 or"), (1, "l17x l4999x"), (2, "été Naïve 你好 ΣΑΣ"), (None, "same line"), (3, ""), (4, None), (5, "# $"), (6, "nowhere")]
    asked = make([(*i, "x", 5) for i in items], "item_id long, text string, doc_id string, score int")
    assert searched(spark, odd, asked) == brute(docs, items, 10)
    assert searched(spark, nothing, asked) == []
    assert searched(spark, odd, asked.limit(0)) == []


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["über", "x-y", "Ab1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([3, 3, 3, 40, rng.randrange(200)])))) for k in range(600)]
    docs += [(1000 + k, "w1 w2 w250") for k in range(200)] + [(2000, None), (2001, "w5 " * 3000 + "w290 " + "w5 " * 3000)]
    return docs, [(k, " ".join(rng.choices(words, weights, k=15))) for k in range(40)]


def test_many_shards_blocks_and_cut_texts(spark, make, monkeypatch):
    docs, items = corpus()
    for name, value in (("SHARD_BYTES", 3000), ("COUNT_BYTES", 100), ("BLOCK_ITEMS", 7), ("FIRST_STRATA", 1)):
        monkeypatch.setattr(lexical_search, name, value)
    table = make(docs, "doc_id long, text string").repartition(5)
    asked = make(items, "item_id long, text string")
    assert searched(spark, table, asked) == brute(docs, items, 10)
    assert searched(spark, table, asked, 3) == brute(docs, items, 3)


def test_strata_below_the_tenth_score_are_not_visited(monkeypatch):
    import numpy as np

    visits = []
    real = np.union1d
    monkeypatch.setattr(lexical_search.np, "union1d", lambda a, b: visits.append(len(b)) or real(a, b))
    m = np.arange(10, 1010)
    one = (m.copy(), 10**9 // (1000 + 8 * m), np.ones(1000, np.int64), np.arange(1000))
    found, score = lexical_search.best_of_shard(m, [one], np.array([5]), np.arange(1000), m, 10)
    assert found.tolist() == list(range(10)) and score[0] == 5 * (10**9 // 1080)
    assert sum(visits) < 100


def test_a_table_against_its_sql(spark, small):
    assert differences(lexical_search.op12_lexical_search(spark, small), connect(small), lexical_search.SQL) is None
