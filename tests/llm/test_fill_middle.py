"""Fill-in-the-middle outputs against a plain version, and the learned index."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, oracle_rows, spark_rows
from tests.llm import brute
from tests.llm.test_operators import awkward, empty
from wakeline.llm import fill_middle, queries

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    code = brute.sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(code[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def outputs(frame):
    made = fill_middle.fill_in_middle(frame)
    back = fill_middle.restored(F.col("output"), F.col("form")).alias("back")
    rows = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()
    return sorted(map(tuple, rows), key=repr)


def hard():
    pieces = ["word", "é́", " ", "\n\n", "\t ", "<P", ">", "一二", " ", "\U0001f600", "x" * 300, "\x1c", "\v"]
    rng = np.random.default_rng(3)
    rows = [(k, "".join(rng.choice(pieces, rng.integers(0, 60)))) for k in range(300)]
    return rows + [(1000, "has <M> inside"), (1001, None), (1002, ""), (1003, " "), (None, "no id here"), (None, None)]


def test_given_documents(spark):
    columns, rows = spark_rows(queries.op12_fill_in_middle(spark, DATA))
    assert (columns, rows) == oracle_rows(connect(DATA), queries.OP12_SQL)
    texts = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert outputs(frame) == sorted((plain_version(*r) for r in texts), key=repr)


@pytest.mark.parametrize("chunk", [1 << 24, 64])
def test_hard_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    frame = spark.createDataFrame(hard(), "doc_id bigint, text string")
    found = outputs(frame)
    assert found == sorted((plain_version(*r) for r in hard()), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_awkward_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    assert outputs(awkward(spark)) == sorted((plain_version(*r) for r in rows), key=repr)
    assert outputs(empty(spark)) == []


@pytest.mark.parametrize("kind", ["even", "random", "jumps", "flat", "one"])
def test_index_is_exact_and_bounded(kind):
    rng = np.random.default_rng(9)
    steps = {
        "even": np.full(20_000, 6),
        "random": rng.integers(1, 12, 20_000),
        "jumps": np.where(rng.random(20_000) < 0.01, 5000, 5),
        "flat": np.zeros(5000),
        "one": np.zeros(1),
    }[kind]
    offsets = np.cumsum(steps).astype(np.int64)
    index = fill_middle.RankIndex()
    for part in np.array_split(offsets, 7):
        index.add(part)
    index.close()
    ranks = rng.permutation(len(offsets))
    assert (index.offsets(ranks) == offsets[ranks]).all()
    assert index.residuals.dtype == np.int8
    if kind == "even":
        assert len(index.firsts) <= 7
    if kind == "random":
        assert len(index.firsts) < len(offsets) / 100
    first, slope = fill_middle.segments(offsets)
    which = np.searchsorted(first, np.arange(len(offsets)), side="right") - 1
    line = offsets[first[which]] + slope[which] * (np.arange(len(offsets)) - first[which])
    assert np.abs(line - offsets).max() <= fill_middle.ERROR + 1e-6
