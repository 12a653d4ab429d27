"""URL filters: host and path rules, and gradient-boosted trees for the rest.

The trees work on lexical features of the URL (lengths, depth, digit share,
entropy, parameters, how often the host's suffix was blocked) and are trained on
the URLs that the rules label.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.sizing import broadcast_if_small
from wakeline.llm.common import settle

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Labelled URLs the trees are trained on, at most.
TRAINING_ROWS = 4000
TREES, DEPTH = 12, 4
FEATURES = (
    "url_length host_length path_length depth labels digit_share entropy parameters "
    "hyphens longest_run suffix_blocked"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(
        F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))
    ).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def suffix_of(host: str) -> Column:
    return F.substring_index(host, ".", -2)


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path`` and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, path = name.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col(
            "path"
        ).startswith(slash + path)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of ``url``, ``host`` and ``path``. A null URL counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    plain = F.regexp_replace(url, r"[^\x20-\x7E]", "?")
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length("plain_") - F.length(F.replace("plain_", c))) / F.length("plain_")
    entropy = F.aggregate(
        F.array_distinct(F.split("plain_", "")),
        F.lit(0.0),
        lambda n, c: n - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumn("plain_", plain).withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/")))).cast("double"),
            "labels": (F.length("host") - F.length(F.replace("host", F.lit(".")))).cast("double"),
            "digit_share": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "entropy": F.when(F.length("plain_") > 0, entropy).otherwise(0.0),
            "parameters": F.when(
                F.length(query) > 0, F.length(query) - F.length(F.replace(query, F.lit("&"))) + 1
            )
            .otherwise(0)
            .cast("double"),
            "hyphens": F.length(F.regexp_replace(url, "[^-_]", "")).cast("double"),
            "longest_run": F.coalesce(
                F.array_max(F.transform(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), F.length)),
                F.lit(0),
            ).cast("double"),
            "suffix": suffix_of("host"),
        }
    ).drop("plain_")


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judge_urls(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and ``blocked`` (the trees' probability).

    The verdict is the rule's where one fits, else the trees'. They are trained on
    at most ``training_rows`` distinct rule-labelled URLs, chosen by a hash within each
    label; the statistics of host suffixes come from all rule-labelled rows, smoothed
    towards their mean. If the rules label one kind only (or nothing), every other URL
    is allowed. Rows with
    a null or odd URL stay and have empty host and path; a null page_id is kept.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(rules)
    rows = (
        pages.select("page_id", "url")
        .withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "ruled": verdict})
    )
    labelled = rows.filter("ruled is not null").select(
        "url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label")
    )
    distinct = labelled.distinct()
    found = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(found) < 2:
        return rows.select(
            *out, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("blocked")
        )
    # By their shares, but a tenth for the rarer label, and what one leaves for the other.
    tenth = training_rows // 10
    blocks = min(max(round(training_rows * found[1.0] / sum(found.values())), tenth), training_rows - tenth)
    blocks = min(max(blocks, training_rows - found[0.0]), found[1.0])
    first = lambda label, n: (
        distinct.filter(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(n)
    )
    chosen = settle(lexical(first(1.0, blocks).union(first(0.0, training_rows - blocks))))
    counts = settle(
        labelled.groupBy(suffix_of("host").alias("suffix")).agg(
            F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")
        )
    )
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    mean = total["bad"] / total["n"]
    blocked_share = counts.select(
        "suffix", ((F.col("bad") + 10 * mean) / (F.col("n") + 10)).alias("suffix_blocked")
    )
    suffixes = broadcast_if_small(blocked_share, counts)

    def with_suffix(frame: DataFrame) -> DataFrame:
        return frame.join(suffixes, "suffix", "left").withColumn(
            "suffix_blocked", F.coalesce("suffix_blocked", F.lit(mean))
        )

    trees = GBTClassifier(
        labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=5, checkpointInterval=-1
    )
    model = trees.fit(settle(_vectors(with_suffix(chosen)).select("features", "label")))
    blocked = F.get(vector_to_array("probability"), F.lit(1))
    return (
        model.transform(_vectors(with_suffix(lexical(rows))))
        .withColumn("blocked", blocked)
        .select(
            *out,
            F.coalesce("ruled", F.when(F.col("blocked") > 0.5, "block").otherwise("allow")).alias("verdict"),
            "blocked",
        )
    )
