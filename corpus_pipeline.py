"""The corpus pipeline: language ID, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and its decisions take effect. All but the
last return the columns of documents; the last adds each row's shard and slot to its doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import decontaminate, langid, mix, neardup, shard
from meshloom.llm.common import table, written
from meshloom.shared import drop, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the model knows; it learns from the rows of docs that have a lang.

    Null text and text without a letter go, and so does everything if no row has a lang. Repeated rows and null ids are judged by their text; very
    long texts are read whole. Empty docs give no rows.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id.

    Rows of null id, null text or without words stay. Of equal rows of one id one stays, and all different texts of the id that stays. Very
    long texts are compared whole. Empty docs give no rows.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item.

    Null and empty texts stay, and so does everything if the benchmark is empty. Repeated rows and null ids are judged by their text; very long
    texts are scanned whole. Empty docs give no rows.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its document: not at all, once or twice.

    Rows of no words aren't taken. Null is a source of its own; a null id draws like any other; repeated rows are taken alike. Empty docs
    give no rows.
    """
    return mix.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; copies of a text share a shard.

    Null texts are a group too. Null ids come first in a shard, repeated rows each have a slot; a very long text is a group like any
    other. Empty docs give no rows.
    """
    return shard.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The sketches and the language model have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again.

    What a stage has written for itself is deleted when its rows are, and those when the next stage has read them.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            before, docs = docs, keep(written(stage(spark, docs, sf_dir)))
        drop(before)
    return docs
