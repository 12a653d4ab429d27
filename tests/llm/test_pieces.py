"""Subword ids by the table of last tokens against the library itself."""

from __future__ import annotations

import codecs
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.test_operators import awkward, empty
from wakeline.llm import prefix_pieces, queries

DATA = "/root/testdata/sf0.001"
PATH = queries.vocabulary_path(queries.PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    codecs.register_error("wakeline-bytewise", prefix_pieces._bytewise)
    return prefix_pieces.Pieces(PATH)


def test_given_documents(spark, library):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    wanted = {}
    for doc_id, text in rows:
        ids = library.encode(text or "")
        wanted[doc_id] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_prefix_pieces(spark, DATA).collect()}
    assert found == wanted


PARTS = ["a", "e", "th", "in", "er", " ", "  ", "▁", "\n", "\t", "\r", "é", "é", "一", "\U0001f600", "<s>",
         "<0x0A>", "\x00", "aaaa", "ß", "22", "!!", "the", "ing", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_ids_of_any_text(pieces, library, parts):
    text = "".join(parts)
    assert pieces.encode(text) == library.encode(text)
    if text:
        (together,) = pieces.learn([" " + text])
        assert np.frombuffer(together, "<u4").tolist() == library.encode(text)


def test_merges_of_any_vocabulary(pieces):
    """Plain merging of words over few letters, where most pieces overlap."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst▁") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.learn(words)]
    for word, ids in zip(words, got):
        symbols = list(word)
        while True:
            scored = [(pieces.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            best = max(scored, default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert [pieces.text[k] for k in ids] == symbols
        assert pieces.word(word) == ids


def test_ids_read_back(pieces, library):
    rng = random.Random(5)
    odd = [0, 1, 2, 13, 35, 3 + 0xC3, 3 + 0xA9, 3 + 0xC8, 259, 28705]
    rows = [[rng.choice([*odd, rng.randrange(32000)]) for _ in range(rng.randrange(8))] for _ in range(3000)]
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    found = pieces.decode(pa.array([k for r in rows for k in r], pa.int32()), offsets)
    assert found.to_pylist() == [library.decode(r) for r in rows]


def test_awkward_tables(spark, library):
    odd = awkward(spark)
    coded = prefix_pieces.encode(odd, PATH)
    given_rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)
    rows = prefix_pieces.decode(coded, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == given_rows
    assert {r["doc_id"]: r["ids"] for r in rows}[4] == library.encode(dict(given_rows)[4])
    assert prefix_pieces.decode(prefix_pieces.encode(empty(spark), PATH), PATH).count() == 0
    lists = spark.createDataFrame([(1, [259, None, 13]), (2, None), (None, [])], "doc_id int, ids array<int>")
    read = {r["doc_id"]: r["text"] for r in prefix_pieces.decode(lists, PATH).collect()}
    assert read == {1: " \n", 2: "", None: ""}


def test_long_texts_in_parts(spark, library, monkeypatch):
    from wakeline.llm import words

    monkeypatch.setattr(words, "CHUNK", 64)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "ciónmi", "\n", "é", "ab▁c", "", "x" * 90]) for _ in range(200)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: r["ids"] for r in prefix_pieces.encode(frame, PATH).collect()}
    assert found == dict(enumerate(library.encode(texts)))
    read = prefix_pieces.round_trip(frame, PATH).collect()
    assert {r["doc_id"]: r["ids"] for r in read} == found
    assert {r["doc_id"]: r["text"] for r in read} == dict(enumerate(map(library.decode, library.encode(texts))))


def test_other_files_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        prefix_pieces.Pieces(queries.vocabulary_path())
