"""The archive and the vector join against brute force, with odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import tracemalloc

import numpy as np
import pytest

from tests.llm.conftest import read, records
from wrenchlake.llm import archive, vector_join
from wrenchlake.session import folders_made, new_shared_folder, stage


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    owner = {}
    for page, html in rows:
        if page is not None:
            owner[html or ""] = max(page, owner.get(html or "", page))
    out = []
    for page, html in rows:
        top = owner.get(html or "")
        kind = "response" if page == top else "revisit"
        out.append((page, len((html or "").encode()), digest(html), kind, None if kind == "response" else top))
    return sorted(out, key=repr)


def archived(spark, pages, **options):
    folder = new_shared_folder(spark)
    archive.write_archive(pages, folder, **options)
    return folder, archive.read_archive(spark, folder)


def plain(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in records(df)), key=repr)


ROWS = [
    (1, "http://a/1", "<p>é</p>"),
    (2, None, "<p>é</p>"),
    (3, "http://a/\r\nX: y", ""),
    (4, "http://b", None),
    (5, "http://c", "x" * 200_000),
    (6, "http://d", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"),
    (7, "http://e", "<p>é</p>"),
]
SCHEMA = "page_id long, url string, html string, digest string, owner int"


def test_archive_round_trip(spark, make):
    pages = make([(*r, "own", 5) for r in ROWS], SCHEMA).repartition(3)
    folder, back = archived(spark, pages)
    assert plain(back) == expected([(r[0], r[2]) for r in ROWS])
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in records(back):
        assert bytes(r["payload"]) == html[r["page_id"]]
        sent = html[r["page_id"]] if r["record_type"] == "response" else b""
        assert bytes(r["record"]) == bytes(r["header"]) + archive.END + sent + archive.END
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == stored.select("address").distinct().count() == 4


def test_archive_of_a_table(spark, small):
    rows = [(p["page_id"], p["html"]) for p in read(small, "pages")]
    assert plain(archive.op1_archive(spark, small)) == expected(rows)


def test_small_payloads_may_all_be_responses(spark, make):
    _, back = archived(spark, make([(*r, "own", 5) for r in ROWS], SCHEMA), least_bytes=100)
    assert {r["record_type"] for r in records(back)} == {"response"}


def test_archive_of_repeated_rows_null_ids_and_nothing(spark, make):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, None, None)]
    _, back = archived(spark, make([(*r, "own", 5) for r in rows], SCHEMA))
    assert len(records(back)) == 4
    _, back = archived(spark, make([], SCHEMA))
    assert records(back) == []


def test_rows_of_one_id_or_none_of_which_one_is_a_copy(spark, make):
    rows = [(7, "u", "a"), (None, "u", "a"), (None, "u", "own"), (5, "u", "a"), (5, "u", "other"), (5, "u", "other"), (3, "u", "other"), (None, "u", "own")]
    folder, back = archived(spark, make([(*r, "own", 5) for r in rows], SCHEMA).repartition(3))
    assert sorted(bytes(r["payload"]) for r in records(back)) == sorted(r[2].encode() for r in rows)
    stored = [bytes(r["payload"]) for r in records(spark.read.parquet(f"{folder}/payloads"))]
    assert sorted(stored) == [b"a", b"other", b"own"]
    kinds = {(r["page_id"], bytes(r["payload"])): r["record_type"] for r in records(back)}
    assert kinds[(None, b"own")] == "response" and kinds[(None, b"a")] == kinds[(5, b"a")] == "revisit"


def test_changed_payload_is_found(spark, make):
    folder, _ = archived(spark, make([(1, "u", "abc", "own", 5)], SCHEMA))
    other = new_shared_folder(spark)
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{folder}/payloads").selectExpr("address", "cast('abd' as binary) payload").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="address"):
        archive.read_archive(spark, other).collect()


def brute_links(rows, cosine=0.95):
    kept = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if vector_join.clean(v) is not None]
    links = {k: [] for k in range(len(rows))}
    for k, a in kept:
        for j, b in kept:
            if j < k and len(a) == len(b) and (a @ b) / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[k].append(j)
                links[j].append(k)
    out, seen = {}, set()
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            out |= {j: min(ids, default=None) for j in group}
    return sorted(((rows[k][0], len(links[k]), out[k], rows[k][0] == out[k]) for k in out), key=repr)


def test_vectors(make, spark, small, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for group in range(6):
        center = rng.normal(size=16)
        rows += [(len(rows) + i, (center + rng.normal(size=16) * spread).tolist()) for i, spread in enumerate([0.05] * 12 + [0.22] * 12)]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, None), (903, [0.0] * 16), (904, [])]
    rows += [(905, [float("nan"), *rows[0][1][1:]]), (906, [None, *rows[0][1][1:]]), (907, [1.0, 0.0]), (908, [1.0, 0.1])]
    rows += [(None, rows[0][1]), (5, rows[40][1]), (909, [1e300] + [0.0] * 15), (910, [1e-300] + [0.0] * 15), (911, [-1.0] + [0.0] * 15)]
    monkeypatch.setattr(vector_join, "CELL_VECTORS", 7)
    monkeypatch.setattr(vector_join, "TILE", 5)
    vectors = make([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string").repartition(3)
    got = sorted((tuple(r) for r in vector_join.near_vectors(vectors).collect()), key=repr)
    small_rows = [(i, v) if v is None or len(v) != 16 or v[0] not in (1e300, 1e-300) else (i, [1.0, *v[1:]]) for i, v in rows]
    assert got == brute_links(small_rows)
    assert vector_join.near_vectors(make([], "vec_id long, embedding array<float>")).count() == 0
    table = [(r["vec_id"], r["embedding"]) for r in read(small, "embeddings")]
    got = sorted((tuple(r) for r in vector_join.op2_vector_join(spark, small).collect()), key=repr)
    assert got == brute_links(table)


def test_vectors_in_many_rounds(make, monkeypatch):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 24))
    rows = [(k, (centers[k % 20] + rng.normal(size=24) * 0.2).tolist()) for k in range(160)]
    rows += [(200 + k, rows[k % 3][1]) for k in range(30)] + [(300 + k, rng.normal(size=10).tolist()) for k in range(9)] + [(None, [0.5] * 10), (400, [0.5] * 10)]
    for name, value in (("HELD_VECTORS", 37), ("FILE_VECTORS", 11), ("PASSING", 9), ("CELL_VECTORS", 5), ("TILE", 3)):
        monkeypatch.setattr(vector_join, name, value, raising=False)
    vectors = make(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in vector_join.near_vectors(vectors).collect()), key=repr)
    assert got == brute_links(rows)


def test_vectors_are_not_copied_for_each_block_and_cell(spark, make):
    """What is shuffled and staged, in the size of the vectors."""
    numbers = np.random.default_rng(9).standard_normal((5000, 64)).astype(np.float32)
    vectors = stage(make([(k, v) for k, v in enumerate(numbers.tolist())], "vec_id long, embedding array<float>"))
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def disk():
        files = [f"{at}/{name}" for top in (*local, *folders_made()) for at, _, names in os.walk(top.removeprefix("file:")) for name in names]
        return sum(os.path.getsize(f) for f in files if os.path.exists(f))

    before = disk()
    assert vector_join.near_vectors(vectors).count() == len(numbers)
    assert disk() - before < 4 * numbers.nbytes


def test_many_near_copies_in_one_cell_take_bounded_memory():
    """At the default sizes: 3072 near copies in 64 dimensions, of which a third pass by those held."""
    rng = np.random.default_rng(4)
    units = vector_join.unit(rng.standard_normal(64) + rng.standard_normal((3072, 64)) * 0.21)
    ids, copies = np.arange(len(units)), rng.integers(1, 4, len(units))
    linked = units @ units.T >= vector_join.COSINE
    np.fill_diagonal(linked, False)
    assert 0.2 < linked.mean() < 0.98
    held, tile, links = 2048, vector_join.TILE, np.zeros(len(units), np.int64)
    blocks = vector_join.Blocks(64, vector_join.COSINE).budgets
    tracemalloc.start()
    for block in range(len(blocks)):
        task = vector_join.CellTask(64, block, vector_join.COSINE)
        for at in range(0, held, tile):
            task.add(ids[at : at + tile], copies[at : at + tile], units[at : at + tile])
        passing = slice(held, len(units))
        found, who, edge = task.visit(ids[passing], copies[passing], units[passing])
        links[:held] += task.links
        links[passing] += found
        assert linked[ids[passing][who], edge].all()
        assert set(who.tolist()) == set(np.flatnonzero(found).tolist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    linked[held:, held:] = False
    assert links.tolist() == (linked @ copies).tolist()
