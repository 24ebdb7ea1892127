"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import bpe, decontaminate, licenses, line_dedup, pii, quality, simhash, suffix, token_files, topk


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.classes(documents(spark, sf_dir), shingle=4, radius=4)


def op3_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256)


def op4_byte_level_bpe(spark, sf_dir):
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), bpe.RankEncoder(ranks, P.PATTERN), then=bpe.digester(ranks), schema=bpe.DIGESTS)


def op5_token_files(spark, sf_dir):
    import public_tokenizers as P

    manifest = token_files.write(documents(spark, sf_dir), bpe.JsonEncoder(P.path("byte_bpe_50k.json")), end_id=0)
    return token_files.checksums(manifest)


def op6_line_dedup(spark, sf_dir):
    return line_dedup.report(documents(spark, sf_dir), passages=True)


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), window=13, share=20).drop("th")


def op8_pii(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return pii.report(pii.find(docs, pii.fit(docs)))


def op9_quality_classifier(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = documents(spark, sf_dir)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select("row.doc_id", "score", (F.col("score") < 0.5).alias("keep"))


def op10_suffix_array_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = suffix.dedup(documents(spark, sf_dir), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash_near_dedup, op3_exact_topk, op4_byte_level_bpe, op5_token_files, op6_line_dedup, op7_benchmark_decontamination, op8_pii, op9_quality_classifier, op10_suffix_array_dedup)}

SQL = {
    "op1_license_scan": licenses.oracle(),
    "op3_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.c::double[], c.c::double[]) as bigint) as score
  from (select distinct * from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id and len(q.c) = len(c.c)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op7_benchmark_decontamination": r"""
with d as (
  select row_number() over () as k, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), i as (
  select distinct coalesce(cast(item_id as varchar), '') as item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), iw as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') as win
  from i, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as t(s) where len(w) > 0
), dw as (
  select k, n, s, array_to_string(w[s + 1 : s + n], ' ') as win
  from d, (select distinct n from iw) l, unnest(range(0, len(w) - n + 1)) as t(s)
), m as (
  select k, s, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win
), h as (
  select k, count(distinct p) as n_hit from m, unnest(range(s, s + n)) as t(p) group by k
), g as (
  select k, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct k, item_id from m) group by k
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (k) left join g using (k)
""",
}
