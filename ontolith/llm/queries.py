"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import html_extract, license_scan, line_dedup, minhash, mixing, mtree, packing, quality, sharding

#: A path, as a parameter: where the tokenizer file of the packing query lies.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.external_shuffle(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("record.text", F.lit(""))
    return shuffled.select(
        "record.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), size=2).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("record.doc_id", "held_out", "score", "predicted")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.html_extract(table(spark, sf_dir, "pages"))
    return found.select("record.page_id", "record.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("record.doc_id", "record.source", "weight", "block", "release", "deadline", "slot", "place")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("record.text", F.lit("")).cast("binary"), 256)
    return cleaned.select("record.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_exact_dedup, op3_license_scan, op4_minhash_near_dedup, op5_quality, op6_exact_topk, op7_html_extraction, op8_packing, op9_mixing, op10_line_dedup, pipeline)
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        with d as (
            select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
        ), best as (
            select doc_id, norm, first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
                count(*) over (partition by norm) as group_size
            from d
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from best
    """,
    "op4_minhash_near_dedup": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), s as (
            select distinct doc_id, unnest(case when len(w) < 2 then w else list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]) end) as shingle from d
        ), n as (
            select doc_id, count(*) as n from s group by 1
        ), coded as (
            select doc_id, code, n from s join n using (doc_id) join (select shingle, row_number() over () as code from s group by 1 having count(*) > 1) using (shingle)
        ), pairs as (
            select a.doc_id as u, b.doc_id as v, any_value(a.n) as m, any_value(b.n) as n, count(*) as common
            from coded a join coded b on a.code = b.code and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2
        ), e as (
            select u, v from pairs where 100 * common >= 80 * (m + n - common) union all select v, u from pairs where 100 * common >= 80 * (m + n - common)
        ), reach as (
            select u, v from e union select r.u, e.v from reach r join e on r.v = e.u
        ), c as (
            select u as doc_id, min(v) as least_id from reach group by 1
        )
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least_id, doc_id)) as component_id, doc_id <= coalesce(least_id, doc_id) as kept
        from documents left join n using (doc_id) left join c using (doc_id)
    """,
    "op6_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
            from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
        )
        select query_id, rank::integer as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
    """,
    "op10_line_dedup": f"""
        with l as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
            from documents
        ), k as (
            select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
        ), shared as (
            select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2
        ), marked as (
            select k.*, coalesce(k.doc_id > shared.first, false) as gone from k left join shared using (key)
        )
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from marked group by doc_id
    """,
}
