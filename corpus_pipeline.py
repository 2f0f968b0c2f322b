"""The corpus pipeline: documents in, shards of clean and mixed documents out.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result
is written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``; the last adds ``shard`` and ``pos``.

Nulls and odd input, in all stages: a null ``doc_id`` is an id like others; null and empty texts are kept
by the first three stages unless the classifier rejects them, weigh nothing in mixing, and are
sharded; very long texts are read whole; of equal rows the near-dedup keeps one, and the stages after it
may repeat that as a whole; columns other than those of ``documents`` are left behind in the first stage,
whatever their names; an empty table, or tables of labels or test items without usable rows, take
nothing away, and an empty table of documents ends in an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tonguemill.llm import decontaminate, mixing, quality_fm, sharding, simhash_trie
from tonguemill.llm.tables import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. Without usable labels none does; ties stay."""
    return quality_fm.keep(docs, quality_fm.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null ids last).
    Documents without words are in no group."""
    return simhash_trie.without_near_copies(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an exact phrase or a proximity match of a test item go. Items may be of any length; null
    and empty ones match nothing."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is there once for each block that takes it. A null
    source is a source; one without any words gives no rows."""
    return mixing.mix(docs).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of exact size, up to one row. Every row is dealt, whatever it holds."""
    return sharding.uniform_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("shard", shards)]

#: No SQL: the first stage trains a model, and the last draws random numbers that SQL
#: hasn't got. tests/llm holds run() and its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{shared_dir(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
