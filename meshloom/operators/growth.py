"""Growth of parts by frontiers over the whole graph: layers around what a part has, as far as its weight lacks, many layers a round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.shared import drop, scratch, written

from .components import components
from .prefix import prefix_sums, ranks
from .refine import running

#: Vertices and edges of a block, which a task takes layer by layer. Vertices beyond are told by joins, once a round.
A_BLOCK = 100_000
#: The key of a vertex that no part has reached.
FAR = (1 << 63) - 1


def spread_seeds(gv: DataFrame, ge: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(v, part): k vertices, the i-th of which is the middle one of the i-th range of (component, x, y, z, v), by a hash of the two middle ones if there are
    two; fewer if there are fewer vertices. From the middle a part has its range on both sides, and none is cut off from its own by a neighbour.

    Components come one after another, so that one with a k-th of the vertices has a seed at least.
    """
    where = gv.select("v", "x", "y", "z").join(components(gv, ge).toDF("v", "component"), "v")
    placed = ranks(where, ["component", "x", "y", "z", "v"], "nth")
    n = gv.count()
    part = F.floor(F.col("nth") * k / F.lit(max(n, 1))).cast("int")
    rows = placed.withColumn("part", part)
    ends = rows.groupBy("part").agg((F.min("nth") + F.max("nth")).alias("twice"))
    middle = rows.join(F.broadcast(ends), "part").where(F.abs(2 * F.col("nth") - F.col("twice")) <= 1)
    return middle.groupBy("part").agg(F.min(F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), "v"))["v"].alias("v")).select("v", "part")


def _blocks(gv: DataFrame, ge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(v, vwgt, block), (block, src, dst) of the edges inside a block, and (v, to, block) of those from v into another block. Blocks follow x, y, z, v;
    a block begins wherever A_BLOCK vertices and ends of edges are full, so it is bounded on any graph."""
    ends = ge.groupBy(F.col("src").alias("v")).agg((F.count("*") + 1).alias("size"))
    sized = gv.select("v", "vwgt", "x", "y", "z").join(ends, "v", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    at = written(prefix_sums(sized, ["x", "y", "z", "v"], "size", "before").select("v", "vwgt", F.floor(F.col("before") / A_BLOCK).alias("block")))
    of = at.select("v", "block")
    both = written(ge.select("src", "dst").join(of.toDF("src", "block"), "src").join(of.toDF("dst", "to_block"), "dst"))
    cross = both.where("block <> to_block").select(F.col("src").alias("v"), F.col("dst").alias("to"), F.col("to_block").alias("block"))
    return at, written(both.where("block = to_block").select("block", "src", "dst")), written(cross)


def _block_layers(step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Takes the vertices of a block (block, v, key, told), and what others told some of them, to the least keys along the edges inside."""

    def run(edges: pa.Table, rows: pa.Table) -> pa.Table:
        v, key, told = (rows[c].to_numpy() for c in ("v", "key", "told"))
        order = np.argsort(v[~told])
        ids, now = v[~told][order], key[~told][order]
        at = np.searchsorted(ids, v[told])
        now[at] = key[told]
        changed = np.zeros(len(ids), bool)
        changed[at] = True
        # edges among free vertices only
        a, b = (np.minimum(np.searchsorted(ids, edges[c].to_numpy()), len(ids) - 1) for c in ("src", "dst"))
        free = (ids[a] == edges["src"].to_numpy()) & (ids[b] == edges["dst"].to_numpy())
        a, b = a[free], b[free]
        b = b[np.argsort(a, kind="stable")]
        start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))])
        at = at[np.argsort(now[at], kind="stable")]
        levels, first = np.unique(now[at] // step, return_index=True)
        coming = list(zip(levels.tolist(), np.split(at, first[1:]), strict=True))[::-1]
        front, level = at[:0], 0
        while len(front) or coming:
            if not len(front):
                level = coming[-1][0]
            if coming and coming[-1][0] == level:
                front = np.concatenate([front, coming.pop()[1]])
            front = np.unique(front)
            front = front[now[front] // step == level]
            many = start[front + 1] - start[front]
            to = b[np.repeat(start[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            new = np.repeat(now[front] + step, many)
            less = new < now[to]
            front = to[less]
            np.minimum.at(now, front, new[less])
            changed[front] = True
            level += 1
        return pa.table({"v": ids, "block": np.full(len(ids), rows["block"][0].as_py()), "key": now, "changed": changed})

    return run


def _keys(free: DataFrame, inner: DataFrame, cross: DataFrame, told: DataFrame, step: int) -> DataFrame:
    """(v, block, key), written, of the free vertices: the least key that reaches each from `told` (v, block, key), an edge adding `step`; FAR if none does.

    A round: each block that was told something less goes through all layers that it has, then its changed vertices tell other blocks. So there are
    as many rounds as a shortest path changes blocks, at most as many as it has edges.
    """
    state = written(free.select("v", "block", F.lit(FAR).alias("key")))
    while not told.isEmpty():
        active = F.broadcast(told.select("block").distinct())
        rows = state.join(active, "block", "left_semi").withColumn("told", F.lit(False)).unionByName(told.withColumn("told", F.lit(True)))
        edges = inner.join(active, "block", "left_semi")
        done = written(edges.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_block_layers(step), "v long, block long, key long, changed boolean"))
        before, state = state, written(done.drop("changed").unionByName(state.join(active, "block", "left_anti").select("v", "block", "key")))
        say = done.where("changed").select("v", "key").join(cross, "v").groupBy(F.col("to").alias("v"), "block").agg((F.min("key") + step).alias("key"))
        told = written(say.join(state.select("v", F.col("key").alias("has")), "v").where("key < has").select("v", "block", "key"))
        drop(before)
        drop(done)
    return state


def _within(reached: DataFrame, ge: DataFrame, own: DataFrame, share: DataFrame) -> DataFrame:
    """(v, part, vwgt, layer): of what a part has reached, its layers in order while they start below its target; of the last of them the vertices with the most
    edge weight into the layer before, until the target is met. own: (v, part) before."""
    sums = prefix_sums(reached.groupBy("part", "layer").agg(F.sum("vwgt").alias("w")), ["layer"], "w", "before", ["part"])
    some = sums.join(F.broadcast(share), "part").select("part", "layer", (F.col("target") - F.col("load") - F.col("before")).alias("room"), "w").where("room > 0")
    able = written(reached.join(some, ["part", "layer"]))
    whole, split = able.where("w <= room").select("v", "part", "vwgt", "layer"), able.where("w > room").drop("w")
    if not (n := split.count()):
        return whole
    inside = reached.select("v", "part", "layer").unionByName(own.select("v", "part", F.lit(0).cast("long").alias("layer")))
    near = ge.join(split.select(F.col("v").alias("dst"), "part", (F.col("layer") - 1).alias("layer")), "dst").join(inside.withColumnRenamed("v", "src"), ["src", "part", "layer"])
    ranked = written(split.join(near.groupBy(F.col("dst").alias("v")).agg(F.sum("w").cast("double").alias("rank")), "v"))
    return whole.unionByName(running(ranked, ["part"], "vwgt", "upto", n).where("upto - vwgt < room").select("v", "part", "vwgt", "layer"))


def grow(gv: DataFrame, ge: DataFrame, seeds: DataFrame, targets: dict[int, float]) -> tuple[DataFrame, int]:
    """(v, part) for every vertex, and the number of layers grown one after another. seeds (v, part), one a part at least; targets: each part's weight.

    A phase: all parts that lack weight grow by layers over the free vertices, at one pace. A vertex goes to the part that reaches it first, of several to that which
    lacked the largest share of its target when the phase began. A part keeps its layers in order while they start below its target, of the last one the vertices with the
    most edge weight into it, so it ends less than a vertex above. What it doesn't keep is free for the next phase; each phase but the last two fills a part, so they are
    as many as parts at most, and two. Once no part with room reaches a free vertex, free vertices go to the part whose layers reach them first, so that parts stay
    connected; components without a seed go whole to the part that lacks most, heaviest first. A phase takes a round a block that layers cross, not one a layer.
    """
    spark = gv.sparkSession
    with scratch(spark) as keep:
        claimed = written(seeds.select("v", F.col("part").cast("int").alias("part")).dropDuplicates(["v"]))
        at, inner, cross = _blocks(gv, ge)
        grown, limited = 0, True
        loads = {p: 0.0 for p in targets}
        for r in claimed.join(gv.select("v", "vwgt"), "v").groupBy("part").agg(F.sum("vwgt").alias("w")).collect():  # a row a part
            loads[r["part"]] += float(r["w"])
        while True:
            able = sorted((loads[p] / t if t else float("inf"), p) for p, t in targets.items() if not limited or loads[p] < t)
            share = spark.createDataFrame([(i, int(p), float(targets[p]), loads[p]) for i, (_, p) in enumerate(able)], "place long, part int, target double, load double")
            step = max(len(able), 1)
            own = claimed.join(F.broadcast(share.select("part", "place")), "part")
            free = written(at.join(claimed, "v", "left_anti"))
            beside = ge.join(own.select(F.col("v").alias("src"), "place"), "src").groupBy(F.col("dst").alias("v")).agg((F.min("place") + step).alias("key"))
            told = written(free.join(beside, "v").select("v", "block", "key"))
            if told.isEmpty():
                if not limited:
                    break
                limited = False
                continue
            keys = _keys(free, inner, cross, told, step).where(F.col("key") < FAR)
            placed = keys.select("v", (F.col("key") % step).alias("place"), F.expr(f"key div {step}").alias("layer"))
            reached = written(placed.join(F.broadcast(share.select("place", "part")), "place").join(free.select("v", "vwgt"), "v").select("v", "part", "vwgt", "layer"))
            took = written(_within(reached, ge, own, share)) if limited else reached
            claimed = written(claimed.unionByName(took.select("v", "part")))
            ends = took.groupBy("part").agg(F.sum("vwgt").alias("w"), F.max("layer").alias("last")).collect()  # a row a part
            for r in ends:
                loads[r["part"]] += float(r["w"])
            grown += max(r["last"] for r in ends)
            if not limited:
                break
        rest = written(gv.join(claimed, "v", "left_anti").select("v", "vwgt"))
        if not rest.isEmpty():
            label = components(gv, ge).join(rest, "v")
            whole = label.groupBy("label").agg(F.sum("vwgt").alias("vwgt")).withColumnRenamed("label", "v").withColumn("rank", F.col("vwgt").cast("double"))
            # components without a seed, heaviest first, fill up what parts lack, one part after another
            lack = sorted(((t - loads[p], p) for p, t in targets.items()), reverse=True)
            bounds, upto = [], 0.0
            for gap, p in lack:
                bounds.append((upto, p))
                upto += max(gap, 0.0)
            line = running(whole.withColumn("one", F.lit(1)), ["one"], "vwgt", "upto", whole.count()).withColumn("from", F.col("upto") - F.col("vwgt"))
            to = F.element_at(F.filter(F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(int(p)).alias("p")) for b, p in bounds]), lambda x: x["b"] <= F.col("from")), -1)["p"]
            claimed = claimed.unionByName(label.join(line.select(F.col("v").alias("label"), to.cast("int").alias("part")), "label").select("v", "part"))
        return keep(written(claimed)), grown
