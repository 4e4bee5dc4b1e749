"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; None: where their package puts them.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all others; 5 best."""
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, and where 512 tokens end."""
    from .token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents")
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), budget=512)
    return counted.withColumnRenamed("id", "doc_id")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as FLAC and back."""
    from .flac import encode_media, media_features

    media = encode_media(_table(spark, sf_dir, "documents"))
    return media_features(media).withColumnRenamed("id", "doc_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes over links of at most three bits."""
    from .simhash import simhash_groups

    groups = simhash_groups(_table(spark, sf_dir, "documents"), words=3, threshold=3)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts' ids and of the decoded text."""
    from .bpe import round_trip_digests

    docs = _table(spark, sf_dir, "documents")
    coded = round_trip_digests(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from .packing import pack_documents

    docs = _table(spark, sf_dir, "documents")
    packed = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return packed.withColumnRenamed("id", "doc_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all documents."""
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings removed from all documents."""
    from .suffix_dedup import removed_runs

    runs = removed_runs(_table(spark, sf_dir, "documents"), length=100)
    return runs.withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document."""
    from .quality import quality_posteriors

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_posteriors(docs, labels).withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"), smallest=0).withColumnRenamed("id", "page_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_token_counts": op2_token_counts,
        "op3_flac": op3_flac,
        "op4_simhash": op4_simhash,
        "op5_bpe": op5_bpe,
        "op6_packing": op6_packing,
        "op7_licenses": op7_licenses,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
        "pipeline": pipeline,
    }


#: Only op1 is SQL over whole tables; the others need a vocabulary, a codec,
#: a digest or a fitted model that DuckDB lacks, or a byte-level self-join
#: that it cannot finish, and are tested against brute force instead.
_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
),
s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.own <> b.own
  WHERE a.vec_id % 50 = 0
),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS "rank"
  FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOP_K}
