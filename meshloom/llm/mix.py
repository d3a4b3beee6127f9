"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's key is an exponential draw over its quality weight; in key order a source's documents are its weighted
sample without replacement. Complete epochs of a source come first, then documents in key order up to the rest of the
token budget. The order is range-partitioned, so that a hot source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, named, tidied, written

#: Weights of the sources in their order, over and over; the share of all sizes that the mix has; most repeats of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Characters that prose rarely has; their share lowers a document's default quality weight.
SYMBOLS = "#$%&*+<=>@[]^_{|}~!"
_WORD = "[^\\x20\\x09-\\x0D]+"


def quality_weight(text: Column) -> Column:
    """1 for plain text, less by four times the share of symbols, 0.05 at least."""
    n = F.length(text)
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1)))


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from the md5 of seed and id: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source (source, source_size) -> target: `share` of all sizes by weight, none above `most` times its size.

    Resharing what is above the caps until none is ends at target = min(cap, level * weight). With sources in the order
    of cap / weight, the level follows from prefix sums. A window over all sources: as many rows as there are sources.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    n = F.lit(len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, n).cast("int") + 1)
    ratio = W.orderBy("_ratio", F.asc_nulls_last("source"))
    everything = W.partitionBy(F.lit(0))
    rows = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
        .withColumn("_at", F.row_number().over(ratio))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(everything)["_level"]
    return rows.withColumn("_common", level).select("source", "source_size", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_common") * F.col("_weight")), F.lit(0.0)).alias("target"))


def _drawn(documents: DataFrame, weight: Column | None, seed: str) -> list[Column]:
    """A document's id, source, size and key."""
    text = F.col("text").cast("string")
    w = quality_weight(F.coalesce(text, F.lit(""))) if weight is None else weight
    return [
        F.col("doc_id").cast("long").alias("_mix_id"),
        F.col("source").cast("string").alias("_mix_source"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("_mix_size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / w).alias("_mix_key"),
    ]


def _placed(drawn: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """drawn with source_size, target, epochs, and whether the document is in the part beyond complete epochs (chosen)."""
    order = [F.asc_nulls_last("_mix_source"), F.asc("_mix_key"), F.asc("_mix_id"), F.asc("_mix_size")]
    # written first, since ranges are cut by a pass of its own: the text is read once
    ranged = written(written(drawn).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_mix_source", "_part").agg(F.sum("_mix_size").alias("_words"))
    targets = source_targets(parts.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, most)
    # a row for each source and range that meet: partitions plus sources
    before = F.coalesce(F.sum("_words").over(W.partitionBy("_mix_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = (
        parts.select(F.col("_mix_source").alias("_source"), F.col("_part").alias("_in"), before.alias("_before"))
        .join(targets.withColumnRenamed("source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
        .drop("_of")
    )
    inside = W.partitionBy("_mix_source", "_part").orderBy("_mix_key", "_mix_id", "_mix_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.withColumn("_to", F.sum("_mix_size").over(inside)).join(starts, F.col("_mix_source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_in")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    middle = F.col("_before") + F.col("_to") - F.col("_mix_size") / 2
    return rows.withColumn("epochs", epochs).withColumn("chosen", middle <= F.col("target") - F.col("epochs") * F.col("source_size"))


@tidied
def mix_documents(documents: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    taken: words that the mix takes of the document, repeats counted. A document is taken whole: as often as its source
    has complete epochs, and once more if the middle of its run of words in key order lies within the rest of the
    target, so a source ends within half a document of it. Null text has size 0, takes nothing. Null is a source of its
    own, the last. A null id draws as the text `null` does; rows of one id follow each other, by size. Very long texts count whole.
    Empty input gives no rows. Other columns aren't read.
    """
    rows = _placed(documents.select(*_drawn(documents, weight, seed)), weights, share, most)
    taken = F.col("_mix_size") * (F.col("epochs") + F.when(F.col("chosen"), 1).otherwise(0))
    return rows.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


#: Up to so many sources what each takes is broadcast; beyond, it is joined by source.
MOST_BROADCAST_SOURCES = 100_000


def mixed_rows(documents: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of documents, all columns as they are, each as often as the mix takes it. Text stays where it is read.

    What mix_documents takes of a source is a run of its key order, so the run's last key says of each row whether it is taken.
    Rows of one id and size are taken alike.
    """
    own, of, epochs, final, copy = fresh(documents, "mix", "mix_of", "mix_epochs", "mix_last", "mix_copy")
    drawn = documents.withColumn(own, F.struct(*_drawn(documents, weight, seed)))
    key = lambda x, i, size: F.struct(F.col(x).alias("_mix_key"), F.coalesce(F.col(i), F.lit(-(1 << 63))).alias("i"), F.col(size).alias("_mix_size"))
    placed = _placed(documents.select(*_drawn(documents, weight, seed)), weights, share, most)
    last = written(placed.groupBy(F.col("_mix_source").alias(of)).agg(F.max("epochs").alias(epochs), F.max(F.when(F.col("chosen"), key("_mix_key", "_mix_id", "_mix_size"))).alias(final)))
    if last.count() <= MOST_BROADCAST_SOURCES:
        last = F.broadcast(last)
    rows = drawn.join(last, F.col(f"{own}._mix_source").eqNullSafe(F.col(of)))
    again = F.when(key(f"{own}._mix_key", f"{own}._mix_id", f"{own}._mix_size") <= F.col(final), 1).otherwise(0)
    times = F.when(F.col(f"{own}._mix_size") > 0, F.col(epochs) + again).otherwise(0).cast("int")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(0), times))).where(F.col(copy) > 0).select([named(c) for c in documents.columns])
