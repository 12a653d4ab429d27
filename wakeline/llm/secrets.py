"""Secret scans with linked credentials.

Three kinds of span stand on their own: an assignment to a telling name, a cloud
access identifier and a long hex run. Three more are weak: an account name, a
dense token and an endpoint. A weak one is reported only when the parts that
complete it stand in the same scope, found by an interval join of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import settle

#: In the order that breaks ties on a start.
KINDS = ("assign", "access", "hex", "account", "token", "endpoint")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "account": r"""(?i)\b(?:client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{32,}",
    "endpoint": r"""https?://[^\x00-\x20"'<>]+""",
}
#: Shortest value of an assignment.
LEAST_VALUE = 6
#: What a part is to the others, and what has to be near a weak one.
ROLES = {"assign": "secret", "access": "name", "hex": "secret", "account": "name", "token": "secret", "endpoint": "place"}
NEEDS = {"account": ("secret",), "token": ("name",), "endpoint": ("name", "secret")}
#: Code points between two parts of one scope at most, and the width of a join bucket.
SCOPE, BUCKET = 200, 256
#: Lengths that are summed in one go; sums of sums follow, so the work stays linear.
RUN = 256

_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def spans_of(text: Column, pattern: str, found: Column, kind: int) -> Column:
    """Spans ``(start, kind, stop)`` in code points of all matches ``found`` of ``pattern``.

    The pieces between matches come from a split by the same pattern. Starts are
    running sums of piece and match lengths, taken in runs of ``RUN`` with the
    runs' totals summed first, so the work stays near linear in the matches.
    """
    none = F.array().cast(_SPANS)
    lengths = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")),
    )
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")),
        lambda c: F.slice(lengths, c * RUN + 1, F.lit(RUN)),
    )

    def total(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])

    begins = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, run: F.struct(
            (acc["at"] + total(run)).alias("at"),
            F.concat(acc["all"], F.array(acc["at"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )

    def within(run: Column, begin: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(begin.alias("at"), none.alias("all")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(
                    acc["all"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (acc["at"] + x["gap"] + x["size"]).alias("stop"),
                        )
                    ),
                ).alias("all"),
            ),
            lambda acc: acc["all"],
        )

    return F.when(F.size(found) > 0, F.flatten(F.zip_with(runs, begins, within))).otherwise(none)


def find_parts(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, base, weak)``: all spans of each row, the weak ones apart.

    ``key`` names the document and its text; equal rows share it and their spans.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)))
    spans = {
        kind: spans_of(F.col("text"), PATTERNS[kind], F.col(kind), k) for k, kind in enumerate(KINDS)
    }
    long_enough = F.transform(
        F.col("assign"), lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 2)) >= LEAST_VALUE
    )
    assigned = F.transform(
        F.filter(
            F.zip_with(spans["assign"], long_enough, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok"))),
            lambda x: x["ok"],
        ),
        lambda x: x["s"],
    )
    return rows.select(
        "doc_id",
        F.concat_ws(
            ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text"))
        ).alias("key"),
        F.concat(assigned, spans["access"], spans["hex"]).alias("base"),
        F.concat(spans["account"], spans["token"], spans["endpoint"]).alias("weak"),
    )


def linked_parts(parts: DataFrame) -> DataFrame:
    """``(key, linked)``: the weak spans whose complement stands within their scope.

    An account needs a secret, a token a name, an endpoint both. Parts meet by
    (key, bucket) and then by their distance, as semi-joins: a scope full of parts
    gives one row per reported span and never the pairs.
    """
    role = F.lit(None).cast("string")
    for k, kind in enumerate(KINDS):
        role = F.when(F.col("p.kind") == k, ROLES[kind]).otherwise(role)
    spread = (
        parts.filter(F.size("weak") > 0)
        .filter(F.size("base") + F.size("weak") > 1)
        .select("key", F.explode(F.concat("base", "weak")).alias("p"))
        .distinct()
        .select("key", "p.*", role.alias("role"))
    )
    near = spread.select(
        F.col("key").alias("near_key"),
        F.col("start").alias("near_start"),
        F.col("stop").alias("near_stop"),
        F.col("role").alias("near_role"),
        F.explode(
            F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("stop") / BUCKET))
        ).alias("near_bucket"),
    )
    weak = spread.filter(F.col("kind") >= 3).withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("start") - SCOPE) / BUCKET), F.floor((F.col("stop") + SCOPE) / BUCKET)
            )
        ),
    )
    meets = (
        (F.col("key") == F.col("near_key"))
        & (F.col("bucket") == F.col("near_bucket"))
        & (F.col("near_start") <= F.col("stop") + SCOPE)
        & (F.col("start") <= F.col("near_stop") + SCOPE)
    )
    found = None
    for kind, needs in NEEDS.items():
        rows = weak.filter(F.col("kind") == KINDS.index(kind))
        for need in needs:
            kept = rows.join(near.filter(F.col("near_role") == need), meets, "left_semi")
            spans = kept.select("key", "start", "kind", "stop").distinct()
            rows = rows.join(spans, ["key", "start", "kind", "stop"], "left_semi")
        done = rows.select("key", "start", "kind", "stop").distinct()
        found = done if found is None else found.union(done)
    return found.groupBy("key").agg(
        F.collect_list(F.struct("start", "kind", "stop")).alias("linked")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Spans of every row: doc_id, base, linked (arrays of start, kind, stop).

    A null text is empty and has none. Nulls in doc_id and repeated rows stay as
    they are.
    """
    parts = settle(find_parts(documents))
    linked = linked_parts(parts)
    return parts.join(linked, "key", "left").select(
        "doc_id", "base", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked")
    )
