"""Benchmark decontamination by a positional inverted index.

Test items are cut into windows of consecutive words, and equal windows are one. Each
is anchored at its rarest word in the training documents; the postings of the anchor
words are met with the windows at the offset of the anchor, and the rest of the window
has to follow at its own offsets. Proximity matches hold most words of a window near
each other; as few may be missing, one of the window's rarest few is there, so
each of these is met with its postings too, and with one more of them nearby. Items
come in only after the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import ascii_lower, settle

#: Words of a window.
WORDS = 10
#: Words outside a window's own span that a proximity match may use on either side,
#: and the share of the window's distinct words that it has to hold.
SLOP, SHARE = 2, 0.8
#: Places of windows that are met with the postings at a time, and characters of their
#: words; a larger benchmark goes in blocks.
BLOCK_PLACES, BLOCK_CHARS = 200_000, 20_000_000

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), _BREAK), "")


def windows(benchmark: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, words)``, and ``(window, item_id)``, whose they are.

    Windows have ``words`` words; an item with fewer is one window. Items without
    words or without an id are left out. A passage that many items share is a few
    windows, and a long item is as many as it has words.
    """
    lists = (
        benchmark.select(F.col("item_id").cast("bigint"), words_of(F.col("text")).alias("list"))
        .filter("item_id is not null and size(list) > 0")
        .select("item_id", "list", F.explode(F.sequence(F.lit(0), F.greatest(F.size("list") - words, F.lit(0)))).alias("start"))
    )
    placed = lists.select("item_id", F.slice("list", F.col("start") + 1, words).alias("words")).distinct()
    # The rows of a checkpoint keep their places, so the numbers stay when a task is done again.
    parts = settle(placed.select("words").distinct()).select(
        F.monotonically_increasing_id().alias("window"), "words"
    )
    return parts, settle(placed.join(parts, "words").select("window", "item_id"))


def term_counts(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """``(term, n)``: how often each test word stands in the documents, 0 included."""
    terms = settle(parts.select(F.explode("words").alias("term")).distinct())
    size = terms.agg(F.count("*"), F.sum(F.length("term"))).first()
    small = size[0] <= BLOCK_PLACES and (size[1] or 0) <= BLOCK_CHARS
    tokens = documents.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = tokens.join(F.broadcast(terms) if small else terms, "term").groupBy("term").count()
    return terms.join(counts, "term", "left").select(
        "term", F.coalesce("count", F.lit(0)).alias("n")
    )


def places(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(window, words, at, term, anchor, pivot, helpers, need)``: where windows meet postings.

    A window's anchor is its rarest word, the first one of equals; windows with a word
    that no document has get none, as they cannot occur. Its pivots are one word more
    of its rarest distinct ones than a proximity match may lack, at every place; those
    that no document has are missing in all of them. A match lacks too few words to
    have only one of the pivots and the next rarest word, so with a pivot stands one of its
    ``helpers``, the others of these. ``need`` is how many distinct words it has.
    """
    rated = (
        parts.select("window", "words", F.posexplode("words").alias("at", "term"))
        .join(counts, "term")
        .groupBy("window")
        .agg(
            F.first("words").alias("words"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "n", "term"))),
                lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), x["at"].alias("at")),
            ).alias("rates"),
        )
    )
    least = F.array_min("rates")
    kinds = F.array_sort(
        F.array_distinct(
            F.transform("rates", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))
        )
    )
    kinds = F.transform(kinds, lambda x: x["term"])
    need = F.ceil(SHARE * F.size("kinds")).cast("int")
    return (
        rated.withColumn("anchor_at", F.when(least["n"] > 0, least["at"]))
        .withColumn("kinds", kinds)
        .withColumn("need", need)
        .withColumn("pivots", F.slice("kinds", 1, F.size("kinds") - F.col("need") + 1))
        .withColumn("rare", F.slice("kinds", 1, F.size("kinds") - F.col("need") + 2))
        .withColumn("place", F.explode("rates"))
        .select(
            "window",
            "words",
            "need",
            F.col("place.at").alias("at"),
            F.col("place.term").alias("term"),
            F.coalesce(F.col("place.at") == F.col("anchor_at"), F.lit(False)).alias("anchor"),
            F.array_contains("pivots", F.col("place.term")).alias("pivot"),
            F.array_remove("rare", F.col("place.term")).alias("helpers"),
            F.col("place.n").alias("n"),
        )
        .filter("n > 0 and (anchor or pivot)")
        .drop("n")
    )


def postings(documents: DataFrame, terms: list[str], reach: int) -> DataFrame:
    """``(doc_id, hash, term, pos, first, around)``: where the terms stand in the documents.

    ``around`` holds the words from ``first`` on, up to ``reach`` on either side of
    ``pos``. Positions are picked within a row, so a posting carries its
    neighbourhood and never the whole text.
    """
    rows = documents.select(
        "doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words")
    )
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(terms)
    )
    first = lambda i: F.greatest(i - reach, F.lit(0))
    return (
        rows.filter(F.size("words") > 0)
        .select(
            "doc_id",
            "hash",
            F.explode(
                F.transform(
                    places,
                    lambda i: F.struct(
                        F.get("words", i).alias("term"),
                        i.alias("pos"),
                        first(i).alias("first"),
                        F.slice("words", first(i) + 1, i - first(i) + reach + 1).alias("around"),
                    ),
                )
            ).alias("p"),
        )
        .select("doc_id", "hash", "p.*")
    )


def matches(documents: DataFrame, found: DataFrame, words: int = WORDS) -> DataFrame:
    """Postings that are matches: ``(doc_id, hash, window, start, stop, exact)``.

    ``found`` is bounded by the block sizes and broadcast; the postings stream past it.
    What is not exact is a proximity match; ``start`` and ``stop`` are in words.
    """
    terms = [r["term"] for r in found.select("term").distinct().collect()]
    first = F.col("pos") - F.col("at") - F.col("first")
    length = F.size("words")
    exact = F.col("anchor") & (first >= 0) & (F.slice("around", F.greatest(first, F.lit(0)) + 1, length) == F.col("words"))
    nearby = F.slice("around", F.greatest(first - SLOP, F.lit(0)) + 1, length + 2 * SLOP)
    near = (
        F.col("pivot")
        & ((F.size("helpers") == 0) | F.arrays_overlap(nearby, "helpers"))
        & (F.size(F.array_intersect("words", nearby)) >= F.col("need"))
    )
    start = F.col("pos") - F.col("at")
    return (
        postings(documents, terms, words + SLOP)
        .join(F.broadcast(found), "term")
        .select("doc_id", "hash", "window", start.alias("start"), (start + length).alias("stop"), exact.alias("exact"), near.alias("near"))
        .filter("exact or near")
        .drop("near")
    )


def find_contamination(documents: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """Per (doc_id, hash of the text) with a match: n_hit, items, near_items, spans.

    ``n_hit`` counts the document's words inside any exact window, ``items`` and
    ``near_items`` are sorted item ids with exact and with proximity matches (an exact
    one is a proximity match too).
    """
    parts, owners = windows(benchmark, words)
    found = settle(places(parts, settle(term_counts(documents, parts))))
    size = found.agg(F.count("*"), F.sum(F.length(F.array_join("words", " ")))).first()
    blocks = max(1, -(-size[0] // BLOCK_PLACES), -(-(size[1] or 0) // BLOCK_CHARS))
    hits = None
    for block in range(blocks):
        part = found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        one = matches(documents, part, words)
        hits = one if hits is None else hits.union(one)
    hits = settle(hits.distinct())
    key = ["doc_id", "hash"]
    span = F.struct(F.col("start").alias("start"), F.col("stop").alias("stop"))
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), span))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["stop"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    # A window may stand in any share of the documents; two numbers a row have a bound by rows.
    small = owners.limit(BLOCK_PLACES + 1).count() <= BLOCK_PLACES
    items = (
        hits.groupBy(*key, "window")
        .agg(F.max("exact").alias("exact"))
        .join(F.broadcast(owners) if small else owners, "window")
        .groupBy(*key)
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
            F.array_sort(F.collect_set("item_id")).alias("near_items"),
        )
    )
    owned = items.select(F.col("doc_id").alias("of_id"), F.col("hash").alias("of_hash"), "items", "near_items")
    return (
        spans.join(owned, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")))
        .select(*key, covered.alias("n_hit"), "items", "near_items", "spans")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """Every row of ``documents(doc_id, text)`` with its matches.

    doc_id, n_words, n_hit, items and near_items (sorted arrays of item ids). A null
    or empty text has no words; null ids and repeated rows stay; an empty benchmark
    hits nothing. Matches are kept per document and text hash, so repeated ids with
    different texts stay apart.
    """
    hits = find_contamination(documents, benchmark, words).drop("spans")
    base = documents.select(
        F.col("doc_id").alias("id_"),
        F.xxhash64("text").alias("sum_"),
        F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<bigint>")
    return base.join(
        hits, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("sum_") == F.col("hash")), "left"
    ).select(
        F.col("id_").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``documents``, all columns whatever their names, in which no window occurs."""
    hits = (
        find_contamination(documents, benchmark, words)
        .filter("n_hit > 0")
        .select(F.col("doc_id").alias("hit_id"), F.col("hash").alias("hit_hash"))
    )
    held = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col("doc_id").alias("own_id"),
        F.xxhash64("text").alias("own_hash"),
    )
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("hit_hash"))
    return held.join(hits, same, "left_anti").select(
        *[F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    )
