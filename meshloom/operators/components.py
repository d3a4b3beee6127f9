"""Connected components by contraction: every vertex joins its least neighbour, and edges between what has joined go on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.shared import scratch, written

#: A key of more than this part of all rows, and of more rows than this, is looked up without a shuffle.
HOT = 1000
#: Edges that are left are solved in one task when they are no more than these.
ONE_TASK = 20_000


def looked_up(rows: DataFrame, key: str, values: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """rows with the other column of `values` (key, value), null where it has no such key. Keys of `values` are unique.

    Keys that have more than a HOT-th of the rows, of which there are fewer than HOT, are looked up in a broadcast; so no key
    brings many rows into one task. `of` has the same keys as rows, and should be a written table.
    """
    of = rows if of is None else of
    (value,) = [c for c in values.columns if c != key]
    hot = of.groupBy(key).count().where(F.col("count") > max(HOT, of.count() // HOT)).select(key)
    some = values.join(F.broadcast(hot), key, "left_semi")
    few = hot.join(F.broadcast(some), key, "left").withColumn("_hot", F.lit(True))
    first = rows.join(F.broadcast(few), key, "left")
    columns = [*rows.columns, value]
    cold = first.where("_hot is null").drop(value, "_hot").join(values, key, "left")
    return first.where("_hot").select(columns).unionByName(cold.select(columns))


def linked(edges: DataFrame) -> DataFrame:
    """(v, label), written, of the vertices that edges (a, b) have: the least vertex of each vertex's component.

    A round lets each vertex join its neighbour that comes first in an order by hash, if that comes before itself, and
    then what that one has joined. Edges inside what has joined are gone, so a round keeps a part of the edges only, about a
    third along a chain. Few edges are solved by one task. Rounds are put together from the last one back.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    rounds: list[DataFrame] = []
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while (left := now.count()) > ONE_TASK:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = near.groupBy("a").agg(F.min(order("b")).alias("first"))
        joined = written(best.select(F.col("a").alias("v"), F.least(F.col("first"), order("a"))["v"].alias("to")))
        beyond = looked_up(joined, "to", joined.toDF("to", "next"))
        step = written(beyond.select("v", F.col("next").alias("to")))
        rounds.append(step)
        ends = looked_up(looked_up(now, "a", step.toDF("a", "na")), "b", step.toDF("b", "nb"), now)
        now = written(ends.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct())
    if left:
        rounds.append(written(now.coalesce(1).mapInArrow(_solved, "v long, to long")))
    if not rounds:
        return written(edges.sparkSession.createDataFrame([], "v long, label long"))
    label = rounds.pop()
    while rounds:
        step = rounds.pop()
        label = written(looked_up(step, "to", label.toDF("to", "last")).select("v", F.coalesce("last", "to").alias("to")))
    least = label.groupBy("to").agg(F.min(F.least("v", "to")).alias("label"))
    return written(looked_up(label, "to", least).select("v", "label"))


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least vertices of the components of all edges of a task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not held:
        return
    ids, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["v", "to"])


def components(gv: DataFrame, ge: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component. An isolated vertex is its own."""
    label = linked(ge.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return gv.select("v").join(label, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def part_components(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, part, label): components inside each part."""
    inner = ge.join(part.toDF("src", "p_src"), "src").join(part.toDF("dst", "p_dst"), "dst").where("p_src = p_dst").select("src", "dst")
    return components(gv, inner).join(part, "v").select("v", "part", "label")


def component_weights(gv: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, label, n, w) of part_components."""
    return parts.join(gv.select("v", "vwgt"), "v").groupBy("part", "label").agg(F.count("*").alias("n"), F.sum("vwgt").cast("long").alias("w"))


def island_neighbours(ge: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, label, nbr_part, ed): weight of a component's edges into each other part."""
    inner = parts.select(F.col("v").alias("src"), "part", "label")
    outer = parts.select(F.col("v").alias("dst"), F.col("part").alias("nbr_part"))
    return ge.join(inner, "src").join(outer, "dst").where("part <> nbr_part").groupBy("part", "label", "nbr_part").agg(F.sum("w").cast("long").alias("ed"))


def component_counts(parts: DataFrame) -> DataFrame:
    """(part, n_components)."""
    return parts.groupBy("part").agg(F.countDistinct("label").alias("n_components"))
