"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tests.llm.conftest import records
from tests.llm.test_documents import brute_components, brute_repeats, words
from wrenchlake.llm import mixing, quality_rules
from wrenchlake.llm.common import arrow_pass
from wrenchlake.session import stage


def check_stages(spark, docs):
    names = docs.columns
    given = records(docs)
    good = stage(corpus_pipeline.STAGES[0][1](spark, docs, ""))
    judged = Counter(r["doc_id"] for r in records(quality_rules.apply_rules(docs)) if r["kept"])
    assert Counter(r["doc_id"] for r in records(good)) == judged

    one = stage(corpus_pipeline.STAGES[1][1](spark, good, ""))
    rows = [(r["doc_id"], r["text"]) for r in records(good)]
    components = brute_components(rows, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert sorted(r["doc_id"] for r in records(one) if r["doc_id"] is not None) == sorted(
        {doc for doc, _, root in components if doc is not None and doc == root}
    )

    cut = stage(corpus_pipeline.STAGES[2][1](spark, one, ""))
    rows = sorted(((r["doc_id"], r["text"]) for r in records(one)), key=lambda x: (x[0] is None, x[0] or 0))
    kept = {doc: n - gone for doc, n, gone, _, _ in brute_repeats(rows)}
    for r in records(cut):
        # A character that was cut apart leaves up to three bytes less at each end of a span.
        assert kept[r["doc_id"]] - 3 * 40 <= len((r["text"] or "").encode()) <= kept[r["doc_id"]]
    assert {r["doc_id"] for r in records(cut)} >= {doc for doc, n in kept.items() if n > 100}

    mixed = stage(corpus_pipeline.STAGES[3][1](spark, cut, ""))
    taken = sum(r["taken"] for r in records(mixing.mix(cut)))
    assert sum(len(words(r["text"])) for r in records(mixed)) == taken

    for df in (good, one, cut, mixed):
        assert df.columns == names
    packed = records(corpus_pipeline.STAGES[4][1](spark, mixed, ""))
    assert sum(r["length"] for r in packed if r["start"] == 0) > 0
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in records(mixed)}
    assert len(given) >= len(records(good)) >= len(records(one)) >= len(records(cut))


def test_stages(spark, small):
    check_stages(spark, spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_rows_and_nothing(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, ""))
        docs.count()


def test_run_returns_the_last_stage(spark, small):
    assert "sequence_id" in corpus_pipeline.run(spark, small).columns


def test_workers_keep_nothing_of_an_earlier_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage(corpus_pipeline.pack_sequences(spark, docs, ""))

    def rows(batch):
        import sys

        return {"held": [sum(m.startswith("wrenchlake_memory_") for m in sys.modules)] * batch.num_rows}

    assert {r["held"] for r in records(arrow_pass(docs.select("doc_id").repartition(8), rows, "held int"))} == {0}


def test_texts_go_to_python_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "'a' AS source", "'en' AS lang")
    corpus_pipeline.keep_good_documents(spark, docs, "")
    assert max(r["n"] for r in records(docs.mapInArrow(sizes, "n long"))) <= 500
