"""The operators as queries over the given tables, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import (
    fill_middle,
    hilbert_shards,
    kmeans_tree,
    line_spread,
    nbsvm,
    packing,
    phrase_index,
    prefix_pieces,
    secrets,
    simhash_trie,
    suffix_arrays,
    url_trees,
    whitening,
)
from wakeline.llm.common import table

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_trees.judge_urls(table(spark, folder, "pages"))


def op2_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_trie.near_groups(table(spark, folder, "documents"))
    return groups.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.concat("base", "linked")).alias("spans"),
    )


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert_shards.shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_arrays.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    found = phrase_index.decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_nbsvm_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = nbsvm.train(documents, table(spark, folder, "labels"))
    return nbsvm.add_scores(documents.select("doc_id", "text"), model).select(
        "doc_id",
        nbsvm.held_out().alias("held_out"),
        "score",
        (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_spread.remove_boilerplate(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op10_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary_path())


def op11_prefix_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded texts as digests. A null or empty text has no ids and decodes to an empty one."""
    read = prefix_pieces.round_trip(table(spark, folder, "documents"), vocabulary_path(PIECES))
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and digests of outputs. A null or empty text is plain with an empty output."""
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components. Vectors that are null or hold null or non-finite entries have no rows."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter,
            op2_simhash_trie,
            op3_secret_scan,
            op4_hilbert_shards,
            op5_suffix_arrays,
            op6_phrase_index,
            op7_nbsvm_quality,
            op8_kmeans_tree,
            op9_line_spread,
            op10_pack_sequences,
            op11_prefix_pieces,
            op12_fill_in_middle,
            op13_whitening,
        )
    }


OP6_SQL = r"""
with words_of as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as (
  select item_id, least(10, len(w)) as size, w[s : s + least(10, len(w)) - 1] as part
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(s)
  where len(w) > 0
), sizes as (select distinct size from item_windows)
, document_windows as (
  select doc_id, s, size, w[s : s + size - 1] as part
  from words_of, sizes, unnest(range(1, len(w) - size + 2)) as t(s)
), hits as (
  select d.doc_id, d.s, d.size, i.item_id
  from document_windows d join item_windows i on i.size = d.size and i.part = d.part
), covered as (
  select doc_id, count(distinct p) as n_hit
  from (select distinct doc_id, s, size from hits), unnest(range(s, s + size)) as t(p)
  group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, cast(item_id as varchar) as name from hits)
  group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words_of left join covered using (doc_id) left join named using (doc_id)
"""

OP9_SQL = r"""
with lines as (
  select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as place,
    unnest(string_split(text, chr(10))) as line
  from documents
), boilerplate as (
  select trim(line, ' ') as line from lines where length(trim(line, ' ')) >= 20
  group by trim(line, ' ') having count(distinct source) >= 10
), marked as (
  select l.*, length(trim(l.line, ' ')) >= 20 and b.line is not null as gone
  from lines l left join boilerplate b on trim(l.line, ' ') = b.line
), kept as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '') as text
  from marked group by doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
  case when d.text is not null then md5(coalesce(k.text, '')) end as kept_md5
from documents d left join kept k using (doc_id)
"""


OP12_SQL = r"""
with tokens as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as code,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t
  from documents
), drawn as (
  select *, len(t) as n, cast('0x' || substr(code, 1, 8) as bigint) as h1, cast('0x' || substr(code, 9, 8) as bigint) as h2,
    cast('0x' || substr(code, 17, 8) as bigint) as h3, cast('0x' || substr(code, 25, 8) as bigint) as h4
  from tokens
), formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
      then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn
), cut as (
  select *, coalesce(array_to_string(t[1 : a], ''), '') as p, coalesce(array_to_string(t[a + 1 : b], ''), '') as m,
    coalesce(array_to_string(t[b + 1 :], ''), '') as s
  from formed
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express on whole tables."""
    return {"op6_phrase_index": OP6_SQL, "op9_line_spread": OP9_SQL, "op12_fill_in_middle": OP12_SQL}
