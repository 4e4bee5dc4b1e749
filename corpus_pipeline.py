"""The corpus pipeline: four stages, each one operator of ``aspectra.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``,
what its predecessor kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import release, written
from aspectra.llm.packing import pack_documents
from aspectra.llm.quality import keep_good
from aspectra.llm.queries import tokenizer_path
from aspectra.llm.simhash import similar_groups
from aspectra.llm.suffix_dedup import removed_runs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are low in quality or toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, labels, host="source", path="lang")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, written so that it stays the same."""
    return written(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the least id, then the first.

    Groups are of five-word shingles at a similarity of 0.8 or more.  Rows
    without an id are in no group and stay.  Rows, not ids, are left out.
    """
    keyed = _keyed(docs)
    groups = similar_groups(
        keyed.filter(F.col("doc_id").isNotNull()), words=5, similarity=0.8, key_col="_key"
    )
    gone = groups.filter(F.col("key") != F.col("first")).select(F.col("key").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier are cut out.

    Texts that lose nothing stay as they are.  A cut may end inside a
    character; what is left of it is dropped, so texts stay UTF-8.  Documents
    of which no character but white space is left go.  Rows that repeat an id
    are cut each for itself, in the order they are stored; rows without an id
    come after all others.
    """
    keyed = _keyed(docs)
    runs = removed_runs(keyed, length=100, keep_text=True, key_col="_key")
    cut = runs.filter(F.col("n_removed") > 0).select(
        F.col("key").alias("_key"), _clean(F.col("kept")).alias("_cut")
    )
    joined = keyed.join(cut, "_key", "left").withColumn("_text", F.coalesce("_cut", "text"))
    # Only texts that were cut down to nothing go; empty ones were empty before.
    joined = joined.filter(F.col("_cut").isNull() | (F.length(F.trim("_cut")) > 0))
    return joined.select(
        *(
            F.col("_text").alias(c)
            if c == "text"
            else F.when(F.col("_cut").isNotNull(), F.length("_cut").cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        )
    )


def _clean(raw):
    """Binary as text, without the pieces of characters that a cut left."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 2048 tokens."""
    packed = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The stages use fitted models, SimHash and a vocabulary: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again.

    What a stage wrote for itself goes once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            release(spark)
    return docs
