"""Data sets kept as JSON lists of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: Documents handed on at a time.
BATCH = 4096


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per document of the JSON lists under ``path``.

    The schema is given, so no file is read to infer it. Keys it does not name are
    ignored, missing keys and nulls are null, and a file that is not JSON fails
    the read. A list is parsed by one task; many files are read side by side. For
    lists larger than a task see ``read_json_lists``.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def _outside(piece: str, quoted: bool) -> tuple[str, bool]:
    """What of a piece stands outside of strings, and whether it ends inside one."""
    parts = _ESCAPED.sub("", piece).split('"')
    return "".join(parts[quoted::2]), quoted ^ (len(parts) % 2 == 0)


def read_json_lists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``read_json_documents`` for lists of any size: a file is read by many tasks.

    Files are read in byte ranges and cut at closing braces. A range alone cannot
    tell whether it starts inside a string or a document, so a first pass
    tells for both cases how strings and depth come out at its end; put
    together in file order (some numbers per range, on the driver) they say where
    each range starts. Documents inside a range are parsed there, and what is left at
    its ends is joined to that of its neighbours. Lists hold documents only; a file that ends within
    one fails the read, and so does one that is not JSON.
    """
    shape = spark.createDataFrame([], schema).schema
    pieces = (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("range"),
            "value",
        )
    )

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for frame in frames:
            for file, start, value in zip(frame["file"], frame["range"], frame["value"]):
                # For either case: in a string now, and the depth since the range began.
                case = found.setdefault((file, start), [[False, 0], [True, 0]])
                for state in case:
                    text, state[0] = _outside(value, state[0])
                    state[1] += text.count("{") - (not state[0])
        yield pd.DataFrame(
            [(*key, *case[0], *case[1]) for key, case in found.items()],
            columns=["file", "range", "plain_quoted", "plain_depth", "quoted_quoted", "quoted_depth"],
        )

    kinds = "plain_quoted boolean, plain_depth bigint, quoted_quoted boolean, quoted_depth bigint"
    ranges = pieces.mapInPandas(measure, f"file string, range bigint, {kinds}").collect()
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    file, quoted, depth = None, False, 0
    for r in [*sorted(ranges, key=lambda r: (r["file"], r["range"])), None]:
        if r is None or r["file"] != file:
            # A file's last piece has no brace behind it.
            if file is not None and (quoted or depth != -1):
                raise ValueError(f"MALFORMED JSON list: {file}")
            if r is None:
                break
            file, quoted, depth = r["file"], False, 0
        starts[file, r["range"]] = (quoted, depth)
        case = "quoted" if quoted else "plain"
        quoted, depth = r[f"{case}_quoted"], depth + r[f"{case}_depth"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, held, quoted, depth, begun = None, [], False, 0, False

        def close() -> None:
            # What is left begins a document, or goes on with one from before.
            if key is not None and depth > 0 and held:
                out.append((*key, 0 if not begun else 2, "".join(held)))

        for frame in frames:
            for file, start, value in zip(frame["file"], frame["range"], frame["value"]):
                if (file, start) != key:
                    close()
                    key, held, begun = (file, start), [], False
                    quoted, depth = starts[key]
                text, quoted = _outside(value, quoted)
                if depth == 0:
                    at = value.find("{")
                    if at < 0:
                        # The end of the list.
                        continue
                    value, begun = value[at:], True
                depth += text.count("{") - (not quoted)
                held.append(value + "}")
                if depth == 0:
                    out.append((*key, 3 if begun else 1, "".join(held)))
                    held, begun = [], False
                    if len(out) >= BATCH:
                        yield pd.DataFrame(out, columns=["file", "range", "part", "value"])
                        out.clear()
        close()
        yield pd.DataFrame(out, columns=["file", "range", "part", "value"])

    found = pieces.mapInPandas(cut, "file string, range bigint, part int, value string")
    # Parts: 0 goes on through the whole range, 1 ends in it, 2 begins in it, 3 is whole.
    in_file = Window.partitionBy("file").orderBy("range", "part")
    joined = (
        found.where("part < 3")
        .withColumn("number", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(in_file))
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("range", "part", "value"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    )
    documents = found.where("part = 3").select("value").unionByName(joined)
    parsed = F.from_json("value", shape, {"mode": "FAILFAST"})
    return documents.select(parsed.alias("document")).select("document.*")
