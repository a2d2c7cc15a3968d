"""The corpus pipeline: language ID, n-gram Jaccard join, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and gives a DataFrame, which :func:`run` writes
as Parquet to shared storage and reads again for the next stage.

A row is known by its id and its text together, so null ids and ids that several texts share are told apart.  Rows that repeat
another in id and text stay or go with it, but for the join, which keeps one of them.  An empty table passes through all stages.
Stages before the last give the columns of ``docs`` and look only at doc_id, text, lang and source; other columns are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import BROADCAST_ROWS, few_tasks, materialise
from quotemill.llm.decontam import find_leaks
from quotemill.llm.langid import keep_placed
from quotemill.llm.mixing import mix_sources, realise
from quotemill.llm.ngram_join import ngram_join
from quotemill.llm.shards import extendible_shards

WORDS_PER_GRAM, PERCENT = 5, 80
SHARD_BYTES = 32 << 20


def _text_key() -> Column:
    return F.xxhash64("text")


def _doc_key() -> Column:
    """The id; without one a number by the text, above all ids below 2**62, so such a document is never kept before one with an id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).cast("long") + F.pmod(_text_key(), F.lit(1 << 61).cast("long")))


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(key.alias("doc_id"), "text")


def _among(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by ``how`` with a written table of distinct keys; it is broadcast only if counted as small."""
    side = keys.toDF("_pipeline_key")
    side = F.broadcast(side) if keys.count() <= BROADCAST_ROWS else side
    return docs.join(side, key == F.col("_pipeline_key"), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier cannot tell: without a letter, or with all labels' classifiers against them."""
    return keep_placed(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar 5-word shingles, the one with the smallest id stays.

    A document without an id is kept only if its group has none with one.  Of rows alike in id and text the one that sorts first by all
    columns stays; other texts under the id that stays are the same document and stay too.
    """
    found = ngram_join(_keyed(docs, _doc_key()), words_per_gram=WORDS_PER_GRAM, percent=PERCENT)
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies", few_tasks(docs))
    left = _among(docs, _doc_key(), gone, "left_anti")
    key = F.xxhash64(_doc_key(), _text_key())
    again = materialise(docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"), "again", few_tasks(docs))
    if again.isEmpty():
        return left
    first = F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("first")
    one = _among(left, key, again, "left_semi").groupBy(key.alias("_pipeline_key")).agg(first).select("first.*")
    return _among(left, key, again, "left_anti").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; each text is judged by itself, whatever its id."""
    key = F.xxhash64(_doc_key(), _text_key())
    leaks = find_leaks(_keyed(docs, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _among(docs, key, materialise(leaks.select("doc_id").distinct(), "leaks", few_tasks(docs)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to the tempered weights; every document is read at least once.

    Rows come as often as they are to be read.  Their reading order (see :func:`mix_sources`) is not among the columns of documents and
    is worked out again from them where it is needed.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = lambda c: names[docs.columns.index(c)]
    mixed = mix_sources(docs.toDF(*names), source_col=at("source"), id_col=at("doc_id"), text_col=at("text"), budget_share=None)
    return realise(mixed, names).select(*names).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, shard_depth and shard_bytes."""
    return extendible_shards(docs, limit_bytes=SHARD_BYTES)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The fitted classifier, the latent search and the bisected weights have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
