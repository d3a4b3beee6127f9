"""Connectivity: islands of a part go to the neighbouring part that holds them most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.shared import written

from .components import component_weights, island_neighbours, part_components
from .metrics import edge_cut, part_weights
from .refine import moved, running


@dataclass(frozen=True)
class Repaired:
    """no_move: the last round moved nothing, though islands without a neighbour may be left. connected: every part is one component."""

    part: DataFrame
    cut: int
    isolated: int
    vertices_moved: int
    no_move: bool
    connected: bool


def islands(weights: DataFrame, keep_largest: float) -> DataFrame:
    """(part, label, n, w) of component_weights that must go: not the heaviest of its part (ties to the lower label).

    Spared: a component of more than 1 - keep_largest of the heaviest, where that has keep_largest of the part or more.
    """
    by = W.partitionBy("part")
    ranked = weights.withColumn("nth", F.row_number().over(by.orderBy(F.desc("w"), F.asc("label")))).withColumn("main", F.max("w").over(by)).withColumn("pw", F.sum("w").over(by))
    spared = (F.col("w") / F.col("main") > 1 - keep_largest) & (F.col("main") >= keep_largest * F.col("pw"))
    return ranked.where(F.col("nth") > 1).where(~spared).select("part", "label", "n", "w")


def enforce_connectivity(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float = 1.05, keep_largest: float = 0.95) -> Repaired:
    """Rounds in which an island moves as a whole to the part with the most edge weight into it of those that it fits into, within ub of the
    ideal. Islands that choose one part in a round come one after another, and those that it then has no room for choose again in the next round.

    An island that fits nowhere goes to the lightest part that it touches, and then one such island a part and round, or as many as
    leave that part no heavier than the heaviest. An island beside another one that moves in the same round waits, so that they don't swap. Without any
    outside edge it stays. In the last of 2 k + 8 rounds all that is left moves.
    """
    now, isolated, count, still = written(part), 0, 0, False
    limit = int(ub * gv.agg(F.coalesce(F.sum("vwgt"), F.lit(0))).first()[0] / max(k, 1) + 0.5)
    connected, rounds = True, 2 * max(k, 1) + 8
    for r in range(rounds):
        parts = written(part_components(gv, ge, now))
        lost = written(islands(component_weights(gv, parts), keep_largest))
        n = lost.count()
        if not n:
            still = True
            connected = parts.groupBy("part").agg(F.countDistinct("label").alias("c")).where("c > 1").limit(1).count() == 0
            break
        into = island_neighbours(ge, parts).join(lost.select("part", "label", "w"), ["part", "label"])
        loads = written(part_weights(gv, now, k))
        room = F.broadcast(loads.toDF("nbr_part", "w_dst"))
        fits = F.col("w_dst") + F.col("w") <= limit
        order = F.struct(fits, F.when(fits, F.col("ed")).otherwise(-F.col("w_dst")).alias("first"), "ed", -F.col("nbr_part"))
        choice = into.join(room, "nbr_part").groupBy("part", "label").agg(F.max_by(F.struct(F.col("nbr_part").alias("dst_part"), "w", "w_dst", "ed", fits.alias("fits")), order).alias("c")).select("part", "label", "c.*")
        # of islands side by side only the one of the lowest label moves
        of = parts.join(lost.select("part", "label"), ["part", "label"]).select("v", "label")
        beside = ge.join(of.toDF("src", "ls"), "src").join(of.toDF("dst", "ld"), "dst").where("ls > ld").select(F.col("ls").alias("label")).distinct()
        # those that fit come first; of them, those with the most weight into the part
        rank = F.when(F.col("fits"), F.col("ed") + F.lit(1.0)).otherwise(-F.col("w")).cast("double")
        able = written(choice.join(beside, "label", "left_anti").withColumn("v", F.col("label")).withColumn("rank", rank))
        top = max((x["w"] for x in loads.collect()), default=0)  # k rows
        queue = running(able, ["dst_part"], "w", "arrived", able.count())
        room_left = F.col("w_dst") + F.col("arrived") <= F.when(F.col("fits"), F.lit(limit)).otherwise(F.lit(top))
        go = queue.where(room_left | (F.col("arrived") == F.col("w")) | F.lit(r == rounds - 1)).select("part", "label", "dst_part")
        moves = written(parts.join(go, ["part", "label"]).select("v", "dst_part"))
        m = moves.count()
        if not m:
            still, connected, isolated = True, False, isolated + n
            break
        isolated += parts.join(moves.select("v"), "v", "left_semi").select("label").distinct().count()
        now = written(moved(now, moves))
        count += m
    else:
        parts = part_components(gv, ge, now)
        connected = parts.groupBy("part").agg(F.countDistinct("label").alias("c")).where("c > 1").limit(1).count() == 0
    return Repaired(now, edge_cut(ge, now).first()["cut"], isolated, count, still, connected)
