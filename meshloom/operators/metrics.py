"""What a partition is worth: weights, degrees, cuts, volumes, balance, gains of moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.geometry import cap
from meshloom.shared import written

from .components import part_components


def labelled_edges(ge: DataFrame, part: DataFrame) -> DataFrame:
    """ge with the parts of both ends, p_src and p_dst."""
    return ge.join(part.toDF("src", "p_src"), "src").join(part.toDF("dst", "p_dst"), "dst")


def part_weights(gv: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(part, w) for all k parts; an empty part weighs 0."""
    have = gv.join(part, "v").groupBy("part").agg(F.sum("vwgt").cast("long").alias("w"))
    every = gv.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    return every.join(have, "part", "left").select("part", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def neighbour_parts(ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, nbr_part, ed): weight of a vertex's edges into each other part."""
    return labelled_edges(ge, part).where("p_src <> p_dst").groupBy(F.col("src").alias("v"), F.col("p_dst").alias("nbr_part")).agg(F.sum("w").cast("long").alias("ed"))


def links(ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, part, nbr_part, ed): weight of a vertex's edges into each part, its own one included. What a round needs of the edges: one
    join on each end and one sum."""
    return labelled_edges(ge, part).groupBy(F.col("src").alias("v"), F.col("p_src").alias("part"), F.col("p_dst").alias("nbr_part")).agg(F.sum("w").cast("long").alias("ed"))


#: Up to so many moves are broadcast; beyond, they are joined.
MOST_BROADCAST_MOVES = 10_000
#: Up to so many vertices that moves touch, themselves and neighbours, are broadcast; one hub alone may have more.
MOST_BROADCAST_TOUCHED = 50_000


def updated_links(table: DataFrame, ge: DataFrame, moves: DataFrame, n: int) -> DataFrame:
    """links after n moves (v, src_part, dst_part), from links before them: lazy, but for the changes at edges of moved vertices, which are written.

    Of the edges only those at moved vertices are joined: each takes its weight from the neighbour's links into the old part and gives
    it to those into the new one. All other rows go on as they are, without a shuffle while what is touched is few. Right even if neighbours move at once.
    """
    hint = F.broadcast if n <= MOST_BROADCAST_MOVES else (lambda x: x)
    at_moved = ge.join(hint(moves.select(F.col("v").alias("src"), "src_part", "dst_part")), "src").where("src <> dst")
    gone, come = F.struct(F.col("src_part").alias("nbr_part"), (-F.col("w")).alias("ed")), F.struct(F.col("dst_part").alias("nbr_part"), F.col("w").alias("ed"))
    delta = written(at_moved.select(F.col("dst").alias("v"), F.inline(F.array(gone, come))))
    near = F.broadcast if n + delta.count() // 2 <= MOST_BROADCAST_TOUCHED else (lambda x: x)
    touched = delta.select("v").unionByName(moves.select("v")).distinct()
    old = table.join(near(touched), "v", "left_semi")
    part = old.select("v", "part").distinct().join(hint(moves.select("v", F.col("dst_part").alias("_to"))), "v", "left").select("v", F.coalesce("_to", "part").cast("int").alias("part"))
    sums = old.select("v", "nbr_part", "ed").unionByName(delta).groupBy("v", "nbr_part").agg(F.sum("ed").cast("long").alias("ed")).where("ed <> 0")
    return table.join(near(touched), "v", "left_anti").unionByName(sums.join(part, "v").select("v", "part", "nbr_part", "ed"))


def moves_of(table: DataFrame) -> DataFrame:
    """(v, src_part, dst_part, topo) of links: each other part that a vertex touches, and by how much a move there lowers the cut."""
    inner = F.sum(F.when(F.col("nbr_part") == F.col("part"), F.col("ed")).otherwise(0)).over(W.partitionBy("v"))
    rows = table.withColumn("id", inner.cast("long")).where("nbr_part <> part")
    return rows.select("v", F.col("part").alias("src_part"), F.col("nbr_part").alias("dst_part"), (F.col("ed") - F.col("id")).alias("topo"))


def cut_of(table: DataFrame) -> int:
    """The edge cut of links."""
    return table.where("nbr_part <> part").agg(F.coalesce(F.sum("ed"), F.lit(0))).first()[0] // 2


def degrees(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, part, id, ed, nnbrs): weight of edges inside and out of the own part, and how many other parts they reach."""
    inside, out = F.col("p_src") == F.col("p_dst"), F.col("p_src") != F.col("p_dst")
    sums = labelled_edges(ge, part).groupBy(F.col("src").alias("v")).agg(
        F.sum(F.when(inside, F.col("w")).otherwise(0)).cast("long").alias("id"),
        F.sum(F.when(out, F.col("w")).otherwise(0)).cast("long").alias("ed"),
        F.countDistinct(F.when(out, F.col("p_dst"))).alias("nnbrs"),
    )
    zero = F.lit(0).cast("long")
    return gv.select("v").join(part, "v").join(sums, "v", "left").select("v", "part", *[F.coalesce(c, zero).alias(c) for c in ("id", "ed", "nnbrs")])


def boundary(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, part) of the vertices with an edge out of their part."""
    return degrees(gv, ge, part).where("ed > 0").select("v", "part")


def edge_cut(ge: DataFrame, part: DataFrame) -> DataFrame:
    """(cut, cut_edges): weight and number of the edges between parts."""
    crossing = labelled_edges(ge, part).where("p_src <> p_dst")
    return crossing.agg((F.coalesce(F.sum("w"), F.lit(0)) / 2).cast("long").alias("cut"), (F.count("*") / 2).cast("long").alias("cut_edges"))


def volume_info(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(v, nbr_part, ed, gv): for each other part that v touches, the boundary size that moving v there would save.

    Neighbours there whose only outside weight is that edge leave the boundary; v itself does if nothing ties it to its part.
    """
    deg = degrees(gv, ge, part)
    near = labelled_edges(ge, part).where("p_src <> p_dst")
    freed = near.join(deg.select(F.col("v").alias("dst"), F.col("ed").alias("ed_dst")), "dst").join(gv.select(F.col("v").alias("dst"), F.col("vsize").alias("size_dst")), "dst")
    by = freed.groupBy(F.col("src").alias("v"), F.col("p_dst").alias("nbr_part")).agg(
        F.sum("w").cast("long").alias("ed"), F.sum(F.when(F.col("ed_dst") == F.col("w"), F.col("size_dst")).otherwise(0)).cast("long").alias("freed")
    )
    own = deg.select("v", "id").join(gv.select("v", "vsize"), "v")
    return by.join(own, "v").select("v", "nbr_part", "ed", (F.col("freed") + F.when(F.col("id") == 0, F.col("vsize")).otherwise(0)).cast("long").alias("gv"))


def exposed(gv: DataFrame, ge: DataFrame, table: DataFrame, part: DataFrame) -> DataFrame:
    """(v, exposed): the boundary size that v's leaving its part would add, of neighbours there that have no edge out yet. `table`: links."""
    out = table.where("nbr_part <> part").select("v").distinct()
    inner = gv.join(part, "v").join(out, "v", "left_anti").select(F.col("v").alias("dst"), F.col("part").alias("p_dst"), "vsize")
    return ge.join(part.toDF("src", "p_src"), "src").join(inner, "dst").where("p_src = p_dst").groupBy(F.col("src").alias("v")).agg(F.sum("vsize").alias("exposed"))


def boundary_volume(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(volume, n_boundary): total size and number of the boundary vertices."""
    return gv.join(boundary(gv, ge, part).select("v"), "v", "left_semi").agg(F.coalesce(F.sum("vsize"), F.lit(0)).cast("long").alias("volume"), F.count("*").alias("n_boundary"))


def communication_volume(gv: DataFrame, ge: DataFrame, part: DataFrame) -> DataFrame:
    """(comm_volume): each vertex's size, once for each other part that it touches."""
    return neighbour_parts(ge, part).join(gv.select("v", "vsize"), "v").agg(F.coalesce(F.sum("vsize"), F.lit(0)).cast("long").alias("comm_volume"))


def imbalance(weights: DataFrame, ub: float) -> DataFrame:
    """(max_imb, avg_imb, balanced) of (part, w): distance from the ideal weight, over and under; balanced: max_imb + 1 <= ub."""
    ideal = weights.agg((F.sum("w") / F.count("*")).alias("ideal"))
    off = weights.crossJoin(F.broadcast(ideal)).select(F.when(F.col("ideal") > 0, F.abs(F.col("w") / F.col("ideal") - 1)).otherwise(0.0).alias("d"))
    return off.agg(F.max("d").alias("max_imb"), (F.sum("d") / F.count("*")).alias("avg_imb")).withColumn("balanced", F.col("max_imb") + 1 <= ub)


def bisection_imbalance(weights: DataFrame, t0: int, t1: int) -> DataFrame:
    """(imbalance): the larger of the two weights over their targets; 1 if a target isn't positive."""
    if t0 <= 0 or t1 <= 0:
        return weights.sparkSession.range(1).select(F.lit(1.0).alias("imbalance"))
    w = [F.max(F.when(F.col("part") == p, F.col("w"))) for p in (0, 1)]
    return weights.agg(F.greatest(w[0] / t0, w[1] / t1).alias("imbalance"))


def best_moves(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float) -> DataFrame:
    """(v, src_part, dst_part, gain): each boundary vertex's best move into a part that it fits; ties to the lower part."""
    weights = part_weights(gv, part, k)
    limit = weights.agg(cap(F.sum("w") / k, ub).alias("cap"))
    able = (
        neighbour_parts(ge, part)
        .join(degrees(gv, ge, part).select("v", F.col("part").alias("src_part"), "id"), "v")
        .join(gv.select("v", "vwgt"), "v")
        .join(F.broadcast(weights.toDF("nbr_part", "w_dst")), "nbr_part")
        .crossJoin(F.broadcast(limit))
        .where("w_dst + vwgt <= cap")
        .withColumn("gain", F.col("ed") - F.col("id"))
    )
    best = F.max(F.struct("gain", (-F.col("nbr_part")).alias("lower")))
    return able.groupBy("v", "src_part").agg(best.alias("b")).select("v", "src_part", (-F.col("b.lower")).cast("int").alias("dst_part"), F.col("b.gain").alias("gain"))


def partition_stats(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float) -> DataFrame:
    """One row: k, cut, volume, max_imb, avg_imb, balanced, components, island_parts (parts of several components)."""
    comps = part_components(gv, ge, part).groupBy("part").agg(F.countDistinct("label").alias("n"))
    counted = comps.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("components"), F.count(F.when(F.col("n") > 1, 1)).alias("island_parts"))
    # cut and boundary from one join of the edges
    out = F.sum(F.when(F.col("p_src") != F.col("p_dst"), F.col("w")).otherwise(0)).cast("long").alias("out")
    by_vertex = gv.join(part.select("v"), "v").join(labelled_edges(ge, part).groupBy(F.col("src").alias("v")).agg(out), "v", "left")
    sums = by_vertex.agg((F.coalesce(F.sum("out"), F.lit(0)) / 2).cast("long").alias("cut"), F.coalesce(F.sum(F.when(F.col("out") > 0, F.col("vsize"))), F.lit(0)).cast("long").alias("volume"))
    row = sums.crossJoin(imbalance(part_weights(gv, part, k), ub)).crossJoin(counted)
    return row.select(F.lit(k).alias("k"), "cut", "volume", "max_imb", "avg_imb", "balanced", "components", "island_parts")
