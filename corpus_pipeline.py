"""A corpus from raw documents to shards: language, near copies, benchmark passages, mixture, shards.

Every stage gets the documents that the one before it left, as a table read from
Parquet, and returns the rows that go on, with the columns they came with; the
last adds ``shard`` and ``slot``.  Stages take empty tables, NULLs, repeated rows
and further columns of any name; what each operator makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from freshet.llm import decontaminate, kd_shards, language_id, minhash_dedup, mixture
from freshet.llm.base import stored

#: Near copies: shingles of five words, similarity in percent.
SHINGLE_WORDS, SIMILAR = 5, 80
SHARDS = 24


def _with_key(docs: DataFrame) -> DataFrame:
    """(document, key): each row whole, under a key of its doc_id and text, so that no column name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    return docs.select(whole, F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("key"))


def _identified(docs: DataFrame, *columns: str) -> DataFrame:
    """The documents for an operator, their doc_id replaced by the key, so that rows without doc_id are told apart too."""
    return docs.select(F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("doc_id"), *columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; those it rejects go."""
    return language_id.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Of repeated rows of one doc_id the first by text stays.  Rows without doc_id stay.
    """
    kept = minhash_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
                                                    F.col("doc_id").alias("id"))
    rows = rows.join(kept.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    one = rows.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("document.text"))).filter("n = 1")
    return one.select("document.*").union(docs.filter("doc_id IS NULL"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_identified(docs, "text"), benchmark, slop=0)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return _with_key(docs).join(hit, "key", "left_anti").select("document.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: not at all, once, or up to three times.

    A document of which the mix takes a fraction of its words counts as one more
    copy with that chance, drawn by a hash of its key, so whole documents keep
    the sources' shares.  A document without words stays once.
    """
    taken = mixture.mix_documents(_identified(docs, "text", "source"), write_blocks=False).groupBy(F.col("doc_id").alias("key")).agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.shiftrightunsigned(F.xxhash64("key", F.lit("copies")), 11) / F.lit(float(1 << 53))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.try_divide("taken", "size") + chance))
    times = taken.select("key", copies.cast("int").alias("copies")).filter("copies > 0")
    repeated = _with_key(docs).join(times, "key").select("document", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return repeated.select("document.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in shards of near equal bytes."""
    return kd_shards.sharded(docs, SHARDS)


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("mixture", mix_sources),
    ("shards", shard),
]
#: SQL can't express the classifier, the sketches or the pseudorandom draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each stage's rows written to shared storage and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
