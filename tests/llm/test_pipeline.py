"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import awkward
from wakeline.llm import nbsvm
from wakeline.llm.common import given_back

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit("x"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_copies", "decontamination", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "near_copies":
            groups = brute.near_groups(list(before.items()))
            assert after.keys() == {component for _, component in groups.values()}
        if name == "decontamination":
            clean = {r[0] for r in brute.contamination(list(before.items()), items) if not r[5]}
            assert after.keys() == clean
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, DATA).count() >= docs.count()


def test_awkward_rows_go_through(spark, tmp_path):
    """Nulls, empty, long and repeated texts, and columns with the stages' own names."""
    clashing = {"score_": F.lit(1), "n_lines": F.lit(2), "a.b": F.lit(3), "own_id": F.lit(4), "row": F.lit(5)}
    docs = awkward(spark).withColumns(clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        if name != "quality":
            assert 0 < out.count() <= docs.count(), name
    pieces = corpus_pipeline.packed(spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {1, 2, 3, 4, 5, 6, 7, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_only_texts_go_to_python_for_a_verdict(spark):
    """Columns of a type that Python workers cannot take, and texts taken once."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.withColumn("length", F.make_interval(days=F.lit(3)))
    kept = corpus_pipeline.quality(spark, odd, DATA)
    assert kept.columns == odd.columns
    assert kept.count() == corpus_pipeline.quality(spark, docs, DATA).count() > 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "MapInArrow" not in plan


def test_scores_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    ratio, weight = rng.standard_normal((2, nbsvm.DIMENSIONS)).astype(np.float32)
    model = nbsvm.Model(ratio, weight, 1.5, -0.2)
    shapes = nbsvm._Shapes()
    for r in nbsvm.add_scores(awkward(spark), model, "found").collect():
        plain = nbsvm.logistic(np.array(model.margin(nbsvm.ngrams(r["text"], shapes))), 1.5, -0.2)
        assert abs(r["found"] - plain) < 1e-5


def test_workers_give_back_what_batches_took(monkeypatch):
    """All batches come through, and nothing of them is left when Arrow's memory is given back."""
    held, real = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            held.append(real.bytes_allocated())
            real.release_unused()

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    before = real.bytes_allocated()
    sizes = [len(b) for b in given_back(pa.array(np.arange(n)).cast(pa.int32()) for n in (1 << 20, 0, 5))]
    assert sizes == [1 << 20, 0, 5]
    assert len(held) == 4 and held[-1] - before < 1 << 20
