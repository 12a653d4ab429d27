"""A training corpus from raw documents: quality, boilerplate, near copies, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and is the next one's ``docs``. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wakeline.llm import line_spread, nbsvm, packing, phrase_index, simhash_trie  # noqa: E402
from wakeline.llm.common import free_name, table  # noqa: E402
from wakeline.llm.queries import vocabulary_path  # noqa: E402
from wakeline.sources.shared import shared_folder  # noqa: E402


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of its input, does not reject.

    A null or empty text is judged as a blank one. Repeated rows share a verdict; an
    empty table stays empty; extra columns are kept whatever their names.
    """
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "score")
    scored = nbsvm.add_scores(docs, model, name)
    return scored.filter(F.col(name) >= nbsvm.THRESHOLD).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites.

    No document goes: one of nothing but such lines becomes an empty text, a null
    text stays null, and repeated rows stay. Extra columns are kept.
    """
    texts = docs.select("doc_id", "text", "source", F.struct(*_all(docs)).alias("row"))
    cut = line_spread.remove_boilerplate(texts)
    return cut.select(
        *[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at two bits or fewer.

    See ``simhash_trie.keep_one`` for which one, and for nulls, repeats and ties.
    """
    return simhash_trie.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as repeated rows do; without benchmark
    items every document stays. Extra columns are kept.
    """
    return phrase_index.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Fingerprints, the classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{name}")
            docs = spark.read.parquet(path)
    return docs
