"""Refinement and balance by rounds of independent moves.

No edge has two movers in a round, so the cut falls by exactly the sum of the accepted topological gains. Acceptance
goes through prefix sums over each destination, or each pair of parts, in ranges; the driver reads one row a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.shared import scratch, written

from .kmeans import calibrated_beta, centroids, with_geo
from .metrics import boundary_volume, cut_of, edge_cut, exposed, links, moves_of, part_weights, updated_links, volume_info
from .prefix import prefix_sums


@dataclass(frozen=True)
class Refined:
    part: DataFrame
    objective: int
    rounds: int
    moves: int


def moved(part: DataFrame, moves: DataFrame) -> DataFrame:
    """part after moves (v, dst_part)."""
    return part.join(moves.select("v", F.col("dst_part").alias("_d")), "v", "left").select("v", F.coalesce("_d", "part").cast("int").alias("part"))


def independent(ge: DataFrame, candidates: DataFrame, seed: int) -> DataFrame:
    """The candidates (v, gain, ...) that beat every candidate neighbour by (gain, hash, lower id)."""
    key = F.struct(F.round("gain", 9).alias("g"), F.xxhash64(F.lit(seed), F.col("v")).alias("h"), (-F.col("v")).alias("i"))
    mine = candidates.select("v", key.alias("k"))
    rival = ge.join(mine.toDF("src", "k_src"), "src").join(mine.toDF("dst", "k_dst"), "dst").where("k_dst > k_src").select(F.col("src").alias("v")).distinct()
    return candidates.join(rival, "v", "left_anti")


#: Up to so many rows a plain window does it.
WINDOW_ROWS = 50_000


def running(rows: DataFrame, by: list[str], value: str, name: str, n: int) -> DataFrame:
    """The sum of `value` from a group's first row up to this one, in the order of falling `rank`, then v. n: how many rows there are.

    More than WINDOW_ROWS go over ranges of (group, rank, v), so that a group isn't one task's.
    """
    order = [F.desc("rank"), F.asc("v")]
    if n <= WINDOW_ROWS:
        return rows.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return prefix_sums(rows, order, value, name, by, inclusive=True)


def rank(seed: int) -> Column:
    """gain, and below that a number from a hash of v: whole gains keep their order, and equal ones fall into different ranges."""
    below = (F.pmod(F.xxhash64(F.lit(seed), F.col("v")), F.lit(1 << 20)) + 1) / F.lit(float(1 << 21))
    return F.col("gain") + F.when(F.col("gain") == F.round("gain"), below).otherwise(0.0)


def _candidates(gv: DataFrame, ge: DataFrame, part: DataFrame, table: DataFrame, k: int, ub: float, mode: str, alpha: float, beta: float | None, targets: dict[int, float] | None = None) -> DataFrame:
    """(v, src_part, dst_part, gain, topo, vwgt): each boundary vertex's best move into a part that it fits and that leaves its own
    part at its least weight or above. mode: cut, volume; with alpha < 1 mixed with the geometric gain. `table`: links of part."""
    moves = moves_of(table)
    if mode == "volume":
        saved = volume_info(gv, ge, part).select("v", F.col("nbr_part").alias("dst_part"), F.col("gv").alias("saved"))
        best = moves.join(saved, ["v", "dst_part"]).join(exposed(gv, ge, table, part), "v", "left").select("v", "src_part", "dst_part", (F.col("saved") - F.coalesce("exposed", F.lit(0))).alias("topo"))
    else:
        best = moves
    if alpha < 1:
        # beta is calibrated to the cut's gains in either mode
        geo = with_geo(gv, moves, centroids(gv, part, k))
        factor = geo.crossJoin(F.broadcast(calibrated_beta(geo))) if beta is None else geo.withColumn("beta", F.lit(beta))
        best = best.join(factor.select("v", "dst_part", "geo", "beta"), ["v", "dst_part"]) if mode == "volume" else factor
        best = best.withColumn("gain", F.lit(alpha) * F.col("topo") + F.lit(1 - alpha) * F.col("beta") * F.col("geo"))
    else:
        best = best.withColumn("gain", F.col("topo").cast("double"))
    weights = part_weights(gv, part, k)
    if targets is None:
        goal = weights.crossJoin(F.broadcast(gv.agg((F.sum("vwgt") / k).alias("ideal"))))
    else:
        goal = weights.join(F.broadcast(gv.sparkSession.createDataFrame([(int(p), float(t)) for p, t in targets.items()], "part int, ideal double")), "part")
    bounds = F.broadcast(goal.select("part", "w", (F.col("w") - F.col("ideal")).alias("over"), (ub * F.col("ideal") + 0.5).cast("long").alias("most"), ((2 - ub) * F.col("ideal") - 0.5).cast("long").alias("least")))
    able = (
        best.join(gv.select("v", "vwgt"), "v")
        .join(bounds.select(F.col("part").alias("dst_part"), F.col("w").alias("w_dst"), F.col("over").alias("over_dst"), "most"), "dst_part")
        .join(bounds.select(F.col("part").alias("src_part"), F.col("w").alias("w_src"), F.col("over").alias("over_src"), "least"), "src_part")
        .where("w_dst + vwgt <= most")
    )
    order = F.struct("gain", (-F.col("over_dst")).alias("w"), (-F.col("dst_part")).alias("p"))
    return able.groupBy("v").agg(F.max_by(F.struct("src_part", "dst_part", "gain", "topo", "vwgt", "w_src", "w_dst", "over_src", "over_dst", "most", "least"), order).alias("b")).select("v", "b.*")


#: Tentative batches of a climb that find nothing better, before it is rolled back.
CLIMB_PATIENCE = 4


def refine(
    gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float = 1.03, rounds: int = 10, mode: str = "cut", alpha: float = 1.0, beta: float | None = None, seed: int = 42,
    stop_on_no_cut_gain: bool = False, targets: dict[int, float] | None = None, climb: int = 0,
) -> Refined:
    """Rounds of independent moves with positive gain, or with none but into a lighter part; the best partition seen is kept.

    cut: the round's cut must be the last one's less the accepted topological gains, which is checked. volume: a round counts only
    if the boundary volume falls, since moves two steps apart may undo each other; else it is taken back and a fourth of the candidates
    is tried, down to a 64th. With alpha < 1 the gain is a mixture, so the cut may rise within a run; of all rounds
    the one of the least objective is returned, so the result is never worse than `part`.
    targets: weights that parts aim at, where they aren't all the same. climb (cut only): where no move gains, up to so many batches of
    the least loss are tried, in which each vertex moves once; each batch's cut is known exactly, and all behind the best one is
    rolled back. Links are kept up to date by the moves (updated_links), not joined anew.
    """
    value = lambda p, table: cut_of(table) if mode == "cut" else boundary_volume(gv, ge, p).first()["volume"]
    with scratch(gv.sparkSession) as keep:
        now = written(part)
        table = written(links(ge, now))
        best, best_value, total, done = now, value(now, table), 0, 0
        at, thin = best_value, 1
        tried, locked, vain = 0, None, 0
        for r in range(rounds + (climb if mode == "cut" else 0)):
            every = _candidates(gv, ge, now, table, k, ub, mode, alpha, beta, targets).where("w_src - vwgt >= least")
            gains = (F.col("gain") > 1e-9) | ((F.abs("gain") <= 1e-9) & (F.col("over_src") - F.col("vwgt") > F.col("over_dst") + F.col("vwgt")))
            free = every if locked is None else every.join(locked, "v", "left_anti")
            cand = written(free.where(gains).where(F.pmod(F.xxhash64("v", F.lit(seed + r)), F.lit(thin)) == 0).withColumn("rank", rank(seed + r)))
            n = cand.count()
            losing = False
            if (not n or r >= rounds) and mode == "cut" and tried < climb:
                # a climb: of all that may still move, those whose loss is least
                tried, losing = tried + 1, not n
                if not n:
                    free = written(free)
                    top = free.agg(F.max("gain")).first()[0]
                    if top is None:
                        break
                    cand = written(free.where(F.col("gain") >= F.lit(top - 1e-9)).withColumn("rank", rank(seed + r)))
                    n = cand.count()
            elif not n or r >= rounds:
                break
            fits = running(running(independent(ge, cand, seed + r), ["dst_part"], "vwgt", "arrived", n), ["src_part"], "vwgt", "left", n)
            fine = F.lit(losing) | (F.col("gain") > 1e-9) | (F.col("over_src") - F.col("left") > F.col("over_dst") + F.col("arrived"))
            moves = written(fits.where("w_dst + arrived <= most and w_src - left >= least").where(fine).select("v", "src_part", "dst_part", "topo", "vwgt"))
            facts = moves.agg(F.count("*").alias("n"), F.coalesce(F.sum("topo"), F.lit(0)).alias("topo")).first()
            if not facts["n"]:
                break
            before = now, table
            now = written(moved(now, moves))
            table = written(updated_links(table, ge, moves, facts["n"]))
            reached = value(now, table)
            if mode == "volume" and reached >= at and thin < 64:
                (now, table), thin = before, 4 * thin
                continue
            if mode == "cut" and reached != at - facts["topo"]:
                raise AssertionError("the cut doesn't fall by the accepted gains: edges lack their other direction")
            done, total = r + 1, total + facts["n"]
            worse = reached >= at
            at = reached
            if reached < best_value:
                best, best_value, vain, locked = now, reached, 0, None
            elif tried:
                vain += 1
                if vain > CLIMB_PATIENCE:
                    break
            if tried and reached >= best_value:
                mine = moves.select("v")
                locked = mine if locked is None else written(locked.unionByName(mine))
            if (mode == "volume" and worse) or (stop_on_no_cut_gain and worse and not losing):
                break
        return Refined(keep(best), best_value, done, total)


def balance_scores(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(v, src_part, dst_part, score): ed - id + 0.5 * (ideal - w_dst) / (ideal + 1) of each boundary vertex and part that it touches."""
    return _scored(moves_of(links(ge, part)), part_weights(gv, part, k), k)


def _scored(moves: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    ideal = weights.agg((F.sum("w") / k).alias("ideal"))
    rows = moves.join(F.broadcast(weights.toDF("dst_part", "w_dst")), "dst_part").crossJoin(F.broadcast(ideal))
    return rows.select("v", "src_part", "dst_part", (F.col("topo") + 0.5 * (F.col("ideal") - F.col("w_dst")) / (F.col("ideal") + 1)).alias("score"))


def balance(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float = 1.03, rounds: int = 20, seed: int = 7, targets: dict[int, float] | None = None) -> Refined:
    """Moves from heavier to lighter neighbouring parts until all are within [(2 - ub), ub] of the ideal weight, or of their targets.

    A round takes each boundary vertex's best scored move to a lighter part, keeps an independent set, and lets each pair of parts
    pass a quarter of its difference, or one vertex. The partition of the least spread is kept.
    """
    read = lambda p: {x["part"]: x["w"] for x in part_weights(gv, p, k).collect()}  # noqa: E731  k rows
    with scratch(gv.sparkSession) as keep:
        now = written(part)
        weights = read(now)
        ideal = sum(weights.values()) / k
        goal = {p: ideal for p in weights} if targets is None else targets
        spread = lambda have: max((abs(x / goal[p] - 1) if goal[p] else 0.0 for p, x in have.items()), default=0.0)
        best, best_spread, done, count = now, spread(weights), 0, 0
        table = None
        for r in range(rounds):
            if all(int((2 - ub) * goal[p] - 0.5) <= w <= int(ub * goal[p] + 0.5) for p, w in weights.items()):
                break
            table = written(links(ge, now)) if table is None else table
            # by how much a part is above its target; with equal targets that orders parts as their weights do
            over = [(p, round(x - goal[p] + ideal)) for p, x in weights.items()]
            w = F.broadcast(gv.sparkSession.createDataFrame(over, "part int, w long"))
            rows = _scored(moves_of(table), w, k).join(gv.select("v", "vwgt"), "v").join(w.toDF("src_part", "w_src"), "src_part").join(w.toDF("dst_part", "w_dst"), "dst_part")
            rows = rows.where((F.col("w_src") - F.col("w_dst") > F.greatest(F.col("vwgt"), F.lit(0.25 * (ub - 1) * ideal))))
            pick = rows.groupBy("v").agg(F.max_by(F.struct("src_part", "dst_part", F.col("score").alias("gain"), "vwgt", "w_src", "w_dst"), F.struct("score", (-F.col("dst_part")).alias("p"))).alias("b")).select("v", "b.*")
            pick = written(pick.withColumn("rank", rank(seed + r)))
            flow = running(independent(ge, pick, seed + r), ["src_part", "dst_part"], "vwgt", "sent", pick.count())
            moves = written(flow.where((F.col("sent") <= (F.col("w_src") - F.col("w_dst")) / 4) | ((F.col("sent") == F.col("vwgt")) & (F.col("w_src") - F.col("vwgt") >= F.col("w_dst")))).select("v", "src_part", "dst_part"))
            n = moves.count()
            if not n:
                break
            now = written(moved(now, moves))
            table = written(updated_links(table, ge, moves, n))
            weights = read(now)
            count, done = count + n, r + 1
            if (s := spread(weights)) < best_spread:
                best, best_spread = now, s
        return Refined(keep(best), edge_cut(ge, best).first()["cut"], done, count)


def geometric_balance(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float = 1.10, rounds: int = 20) -> Refined:
    """Boundary vertices of overweight parts go to the nearest other centre whose part stays within 1.05 * ub of the ideal."""
    with scratch(gv.sparkSession) as keep:
        now, done, count = written(part), 0, 0
        for r in range(rounds):
            have = {x["part"]: x["w"] for x in part_weights(gv, now, k).collect()}
            ideal = sum(have.values()) / k
            if all(w <= ub * ideal for w in have.values()):
                break
            w = gv.sparkSession.createDataFrame(list(have.items()), "part int, w long")
            cent = centroids(gv, now, k).select("part", "cx", "cy", "cz")
            edge = links(ge, now).where("nbr_part <> part").select("v", F.col("part").alias("src_part")).distinct().join(F.broadcast(w.toDF("src_part", "w_src")), "src_part").where(F.col("w_src") > ub * ideal)
            at = edge.join(gv.select("v", "vwgt", "x", "y", "z"), "v").crossJoin(F.broadcast(cent.join(w, "part").agg(F.collect_list(F.struct("part", "cx", "cy", "cz", "w")).alias("_cent"))))
            able = F.filter("_cent", lambda c: (c["part"] != F.col("src_part")) & (c["w"] + F.col("vwgt") <= 1.05 * ub * ideal))
            near = F.array_min(F.transform(able, lambda c: F.struct(((F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"]) + (F.col("z") - c["cz"]) * (F.col("z") - c["cz"])).alias("d2"), c["part"].alias("dst_part"), c["w"].alias("w_dst"))))
            pick = at.withColumn("_b", near).where("_b is not null").select("v", "src_part", F.col("_b.dst_part").alias("dst_part"), (-F.col("_b.d2")).alias("gain"), "vwgt", "w_src", F.col("_b.w_dst").alias("w_dst"))
            pick = written(pick.withColumn("rank", rank(r)))
            n = pick.count()
            fits = running(running(pick, ["dst_part"], "vwgt", "arrived", n), ["src_part"], "vwgt", "left", n)
            moves = written(fits.where((F.col("w_dst") + F.col("arrived") <= 1.05 * ub * ideal) & (F.col("w_src") - F.col("left") + F.col("vwgt") > ub * ideal)).select("v", "dst_part"))
            n = moves.count()
            if not n:
                break
            now = written(moved(now, moves))
            done, count = r + 1, count + n
        return Refined(keep(now), edge_cut(ge, now).first()["cut"], done, count)
