"""Token ids by merge rounds against the library, word by word and over tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm.conftest import read, records
from wrenchlake.llm import merge_rounds


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=merge_rounds.default_model())


@pytest.fixture(scope="module")
def pieces():
    return merge_rounds.Pieces(merge_rounds.default_model())


ODD = [None, "", " ", "  ", " a  b ", "a\nb\tc", "▁x ▁ y", "\x00a", "<s> <0x0A> </s> <unk>", "你好😀", "ﬁ  Å é", " " * 100, " " * 37 + "x", "=" * 101 + "-" * 77]
ALPHABETS = ["ab ", "abcdefgh  ", "=-#*/ \n", "етоианл ", "你好的是 不", "aAbB0123456789", "▁ a_", "éàü ß😀\t", "\"'();{}=   "]


def agree(pieces, library, texts):
    ids, bounds = pieces.encode(pa.array(texts, pa.string()))
    back = pieces.decode(ids, bounds).to_pylist()
    for k, text in enumerate(texts):
        wanted = library.encode(text or "")
        assert ids[bounds[k] : bounds[k + 1]].tolist() == wanted, repr(text)[:200]
        assert back[k] == library.decode(wanted)


def test_random_texts(pieces, library):
    agree(pieces, library, ODD)
    rng = random.Random(3)
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for _ in range(60):
        letters = rng.choice(ALPHABETS)
        agree(pieces, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(10)])
        agree(pieces, library, ["".join(rng.choice(names) for _ in range(rng.randrange(80))) for _ in range(10)])


def test_long_words_by_the_agenda(pieces, library, monkeypatch):
    monkeypatch.setattr(merge_rounds, "LONG", 10)
    pieces.words.known.clear()
    rng = random.Random(4)
    for letters in ALPHABETS * 3:
        agree(pieces, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(10)])
    monkeypatch.undo()
    pieces.words.known.clear()
    agree(pieces, library, ["ab" * 30_000, " " * 50_000 + "x", "".join(rng.choice("abcdefgh=") for _ in range(50_000))])


def test_ids_that_no_text_gives(pieces, library):
    for ids in ([1, 450, 2], [0, 5, 200, 300], [230, 191, 198, 450], [3], [1, 29871, 450], [29871, 29871], [195], [], [2, 0, 2, 450]):
        assert pieces.decode(np.array(ids, np.int32), np.array([0, len(ids)])).to_pylist() == [library.decode(ids)]
    with pytest.raises(ValueError, match="model"):
        pieces.decode(np.array([32_000], np.int32), np.array([0, 1]))


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        out.append((doc_id, len(ids), *sha))
    return sorted(out, key=repr)


def digests(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in records(df)), key=repr)


def test_a_whole_table(spark, small, library):
    got = digests(merge_rounds.op11_merge_rounds(spark, small))
    assert got == expected(library, [(r["doc_id"], r["text"]) for r in read(small, "documents")])


def test_odd_rows_and_other_columns(spark, odd, nothing, library, make):
    encoded = merge_rounds.encode(odd.withColumnRenamed("kept", "ids"))
    assert "text" not in encoded.columns and dict(encoded.dtypes)["ids"] == "array<int>"
    back = merge_rounds.decode(encoded.withColumnRenamed("lang", "text"))
    assert sorted(back.columns) == sorted(["doc_id", "text", "source", "n_chars", "size", "ids", "n_words"])
    got = sorted(((r["doc_id"], r["n_chars"], tuple(r["ids"]), r["text"]) for r in records(back)), key=repr)
    wanted = []
    for r in records(odd):
        ids = library.encode(r["text"] or "")
        wanted.append((r["doc_id"], r["n_chars"], tuple(ids), library.decode(ids)))
    assert got == sorted(wanted, key=repr)
    assert records(merge_rounds.decode(merge_rounds.encode(nothing))) == []
    lists = make([(1, None), (2, []), (3, [450, 450])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in records(merge_rounds.decode(lists))} == {1: "", 2: "", 3: library.decode([450, 450])}
