"""Many labellings of one graph side by side: a vector a vertex, an entry a trial.

labels(v, parts): parts[t] is v's part in trial t. One pass over the edges gives the links, cuts and gains of all trials, and a second one tells
which of their movers are independent; so a round of refinement reads the edges twice, however many trials there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.shared import scratch, written

from .refine import rank, running


@dataclass(frozen=True)
class Tried:
    """labels; cuts: a number a trial; rounds; moves of all trials."""

    labels: DataFrame
    cuts: list[int]
    rounds: int
    moves: int


def side_by_side(parts: DataFrame) -> DataFrame:
    """labels of parts (trial, v, part), in the order of the trials' numbers; each trial has each vertex once."""
    both = F.sort_array(F.collect_list(F.struct("trial", "part")))
    return parts.groupBy("v").agg(both["part"].alias("parts"))


def project(cmap: DataFrame, labels: DataFrame) -> DataFrame:
    """labels of the fine graph: each vertex has its coarse vertex's."""
    return cmap.join(labels.withColumnRenamed("v", "cv"), "cv").select("v", "parts")


def part_of(labels: DataFrame, trial: int) -> DataFrame:
    """part(v, part) of one trial."""
    return labels.select("v", F.col("parts")[trial].alias("part"))


def links(ge: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, trial, part, nbr_part, ed): weight of a vertex's edges into each part, its own one included, in each trial."""
    ends = ge.join(labels.toDF("src", "_a"), "src").join(labels.toDF("dst", "_b"), "dst")
    each = ends.select("src", "w", F.posexplode(F.zip_with("_a", "_b", lambda a, b: F.struct(a.alias("part"), b.alias("nbr_part")))).alias("trial", "_p"))
    return each.groupBy(F.col("src").alias("v"), "trial", "_p").agg(F.sum("w").cast("long").alias("ed")).select("v", "trial", "_p.part", "_p.nbr_part", "ed")


def loads(gv: DataFrame, labels: DataFrame, k: int, trials: int) -> DataFrame:
    """(trial, part, w) for all k parts of all trials; an empty part weighs 0. k x trials rows."""
    have = labels.join(gv.select("v", "vwgt"), "v").select("vwgt", F.posexplode("parts").alias("trial", "part")).groupBy("trial", "part").agg(F.sum("vwgt").cast("long").alias("w"))
    every = gv.sparkSession.range(k * trials).select(F.floor(F.col("id") / k).cast("int").alias("trial"), (F.col("id") % k).cast("int").alias("part"))
    return every.join(have, ["trial", "part"], "left").select("trial", "part", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def cuts_of(table: DataFrame, trials: int) -> list[int]:
    """The edge cut of each trial's links."""
    got = table.where("nbr_part <> part").groupBy("trial").agg(F.sum("ed").alias("w")).collect()  # a row a trial
    have = {r["trial"]: r["w"] // 2 for r in got}
    return [have.get(t, 0) for t in range(trials)]


def _candidates(gv: DataFrame, table: DataFrame, weights: DataFrame, ub: float) -> DataFrame:
    """(v, trial, src_part, dst_part, gain, vwgt, ...): in each trial each boundary vertex's best move that both parts' weights allow, and
    that lowers the cut, or keeps it and goes to a lighter part."""
    inner = F.sum(F.when(F.col("nbr_part") == F.col("part"), F.col("ed")).otherwise(0)).over(W.partitionBy("v", "trial"))
    moves = table.withColumn("_id", inner).where("nbr_part <> part").select("v", "trial", F.col("part").alias("src_part"), F.col("nbr_part").alias("dst_part"), (F.col("ed") - F.col("_id")).alias("gain"))
    goal = weights.withColumn("_ideal", F.avg("w").over(W.partitionBy("trial")))
    bounds = F.broadcast(written(goal.select("trial", "part", "w", (ub * F.col("_ideal") + 0.5).cast("long").alias("most"), ((2 - ub) * F.col("_ideal") - 0.5).cast("long").alias("least"))))
    able = (
        moves.join(gv.select("v", "vwgt"), "v")
        .join(bounds.select("trial", F.col("part").alias("dst_part"), F.col("w").alias("w_dst"), "most"), ["trial", "dst_part"])
        .join(bounds.select("trial", F.col("part").alias("src_part"), F.col("w").alias("w_src"), "least"), ["trial", "src_part"])
        .where("w_dst + vwgt <= most and w_src - vwgt >= least and (gain > 0 or (gain = 0 and w_src - vwgt > w_dst + vwgt))")
    )
    order = F.struct("gain", (-F.col("w_dst")).alias("w"), (-F.col("dst_part")).alias("p"))
    best = F.max_by(F.struct("src_part", "dst_part", "gain", "vwgt", "w_src", "w_dst", "most", "least"), order)
    return able.groupBy("v", "trial").agg(best.alias("b")).select("v", "trial", "b.*")


def independent(ge: DataFrame, candidates: DataFrame, trials: int, seed: int) -> DataFrame:
    """The candidates (v, trial, gain, ...) that beat every neighbour that is a candidate of the same trial. One join of the edges on each end."""
    key = F.struct("gain", F.xxhash64(F.lit(seed), F.col("trial"), F.col("v")).alias("h"), (-F.col("v")).alias("i"))
    by_trial = F.map_from_entries(F.collect_list(F.struct("trial", key.alias("k"))))
    every = F.sequence(F.lit(0), F.lit(trials - 1))
    mine = candidates.groupBy("v").agg(by_trial.alias("_m")).select("v", F.transform(every, lambda t: F.try_element_at("_m", t)).alias("_k"))
    met = ge.where("src <> dst").join(mine.toDF("src", "_s"), "src").join(mine.toDF("dst", "_d"), "dst")
    lost = met.select(F.col("src").alias("v"), F.explode(F.filter(every, lambda t: F.get("_d", t) > F.get("_s", t))).alias("trial")).distinct()
    return candidates.join(lost, ["v", "trial"], "left_anti")


def moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """labels after moves (v, trial, dst_part)."""
    to = moves.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("trial", "dst_part"))).alias("_m"))
    after = F.transform("parts", lambda p, t: F.coalesce(F.try_element_at("_m", t), p))
    return labels.join(to, "v", "left").select("v", F.when(F.col("_m").isNull(), F.col("parts")).otherwise(after).alias("parts"))


def refine(gv: DataFrame, ge: DataFrame, labels: DataFrame, trials: int, k: int, ub: float = 1.03, rounds: int = 4, seed: int = 42) -> Tried:
    """Rounds of independent moves in all trials at once; no trial's cut rises, and each falls by exactly its accepted gains, which is checked.

    A trial without a move is done, while others go on. Acceptance goes by running totals over each trial's parts.
    """
    with scratch(gv.sparkSession) as keep:
        now = written(labels)
        table = written(links(ge, now))
        cuts, done, total = cuts_of(table, trials), 0, 0
        for r in range(rounds):
            cand = written(_candidates(gv, table, loads(gv, now, k, trials), ub).withColumn("rank", rank(seed + r)))
            n = cand.count()
            if not n:
                break
            fits = running(running(independent(ge, cand, trials, seed + r), ["trial", "dst_part"], "vwgt", "arrived", n), ["trial", "src_part"], "vwgt", "left", n)
            fine = (F.col("gain") > 0) | (F.col("w_src") - F.col("left") > F.col("w_dst") + F.col("arrived"))
            moves = written(fits.where("w_dst + arrived <= most and w_src - left >= least").where(fine).select("v", "trial", "dst_part", "gain"))
            gained = {x["trial"]: (x["n"], x["g"]) for x in moves.groupBy("trial").agg(F.count("*").alias("n"), F.sum("gain").alias("g")).collect()}  # a row a trial
            if not gained:
                break
            now = written(moved(now, moves))
            table = written(links(ge, now))
            reached = cuts_of(table, trials)
            if reached != [c - gained.get(t, (0, 0))[1] for t, c in enumerate(cuts)]:
                raise AssertionError("the cuts don't fall by the accepted gains: edges lack their other direction")
            cuts, done, total = reached, r + 1, total + sum(n for n, _ in gained.values())
        return Tried(keep(now), cuts, done, total)


def best(gv: DataFrame, tried: Tried, k: int, ub: float) -> int:
    """The trial that is within ub, then of the least cut, then the first. The driver reads a row a trial."""
    trials = len(tried.cuts)
    w = loads(gv, tried.labels, k, trials)
    off = w.withColumn("_ideal", F.avg("w").over(W.partitionBy("trial"))).groupBy("trial").agg(F.max(F.when(F.col("_ideal") > 0, F.abs(F.col("w") / F.col("_ideal") - 1)).otherwise(0.0)).alias("off"))
    far = {r["trial"]: r["off"] for r in off.collect()}
    return min(range(trials), key=lambda t: (far[t] + 1 > ub + 1e-9, tried.cuts[t], t))
