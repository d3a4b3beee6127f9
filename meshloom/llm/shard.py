"""Sharding by longest-processing-time scheduling: groups of equal texts, largest first, each to the least-loaded shard.

Groups of one size are interchangeable for the schedule, so the driver plays the heap over (size, number of
groups) alone, a range of sizes at a time, and writes for each size in which order the shards take its groups. Groups then find
their place in that order by a range-partitioned rank. Neither a task nor the driver holds more than a range, whatever the size of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.components import looked_up
from meshloom.shared import own_path

from .common import tidied, written

SHARDS = 16
_LOW = (1 << 33) - 1


#: Sizes whose orders the driver holds at once.
STEP_SIZES = 50_000


def take_size(loads: list[int], size: int, count: int) -> tuple[list[int], list[list[int]]]:
    """Longest processing time first for `count` groups of one size, added to loads.

    Returns starts and orders: the groups from starts[k] on go to orders[k], over and over, until starts[k + 1].
    A heap of (load, shard) would pop the same shards: of the values load + j * size, smallest first, ties to the lower
    shard. Those lie in levels (load // size + j), and a level's shards come in the order of (load % size, shard).
    """
    starts: list[int] = []
    orders: list[list[int]] = []
    level = [x // size for x in loads]
    order = sorted(range(len(loads)), key=lambda i: (loads[i] % size, i))
    bounds = sorted(set(level))
    done = 0
    for k, low in enumerate(bounds):
        active = [i for i in order if level[i] <= low]
        room = len(active) * (bounds[k + 1] - low) if k + 1 < len(bounds) else count - done
        n = min(count - done, room)
        starts.append(done)
        orders.append(active)
        whole, rest = divmod(n, len(active))
        for at, i in enumerate(active):
            loads[i] += size * (whole + (at < rest))
        done += n
        if done == count:
            break
    return starts, orders


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(_size, o: starts and orders of take_size) for all (_size, n), sizes falling, by a driver that reads them range by range."""
    spark = sizes.sparkSession
    path = own_path(spark)
    form = pa.schema([("_size", pa.int64()), ("o", pa.struct([("starts", pa.list_(pa.int64())), ("orders", pa.list_(pa.list_(pa.int32())))]))])
    loads, rows = [0] * shards, []

    def flush() -> None:
        spark.createDataFrame(pa.Table.from_pylist(rows, form)).write.mode("append").parquet(path)
        rows.clear()

    for r in sizes.orderBy(F.desc("_size")).toLocalIterator():  # a range at a time
        starts, orders = take_size(loads, r["_size"], r["n"])
        rows.append({"_size": r["_size"], "o": {"starts": starts, "orders": orders}})
        if len(rows) >= STEP_SIZES:
            flush()
    flush()
    return spark.read.schema("_size long, o struct<starts: array<long>, orders: array<array<int>>>").parquet(path)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df, written, with `_rank`: the place of each row in the order, from 0, without one task that sees all rows."""
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["_p"]: r["count"] for r in at.groupBy(F.shiftright("_at", 33).cast("int").alias("_p")).count().collect()}  # a row a partition
    before = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=0) + 1))])
    start = F.element_at(F.lit(before), F.shiftright("_at", 33).cast("int") + 1)  # an array in the plan: a table of it would be made by Python workers and joined
    return at.withColumn("_rank", start + F.col("_at").bitwiseAND(_LOW)).drop("_at")


@tidied
def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null) for every row.

    Size: bytes of the text plus 1. Rows of equal texts share a shard, and so do all rows of null text (size 1, null
    text_crc32). Groups of equal size are taken in the order of the md5 of their text, null text last; a shard's rows lie
    in the order of doc_id, null first. Very long texts count whole. Repeated rows each have a slot. Empty input gives no rows. Other
    columns aren't read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("_key")))
    groups = ranked(rows.groupBy("_key").agg(F.sum("size").alias("_size")), F.desc("_size"), F.asc("_key"))
    # a row for each distinct size: of n bytes in all there are under sqrt(2 n)
    sizes = written(groups.groupBy("_size").agg(F.min("_rank").alias("first"), F.count("*").alias("n")))
    plan = sizes.select("_size", "first").join(schedule(sizes.select("_size", "n"), shards), "_size").select("_size", F.struct("first", "o.starts", "o.orders").alias("plan"))
    nth = F.col("_rank") - F.col("plan.first")
    run = F.size(F.filter("plan.starts", lambda x: x <= nth))  # a start may repeat where a run holds nothing; the last of them is the one in force
    order = F.element_at("plan.orders", run)
    shard = F.element_at(order, ((nth - F.element_at("plan.starts", run)) % F.size(order) + 1).cast("int"))
    placed = looked_up(groups, "_size", plan).select("_key", shard.cast("int").alias("shard"))
    placed = looked_up(rows, "_key", placed).drop("_key")
    out = ranked(placed, F.asc("shard"), F.asc("doc_id"))
    loads = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    begin = F.lit(0)
    for i in range(1, shards):
        begin = F.when(F.col("shard") == i, F.lit(sum(loads.get(x, 0) for x in range(i)))).otherwise(begin)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
