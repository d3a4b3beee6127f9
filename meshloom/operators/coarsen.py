"""Matching and contraction: match scores, mutual-best rounds, coarse graphs, projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.geometry import d2
from meshloom.shared import written

#: The reference squared edge length is a mean over the edges of the vertices of the lowest ids.
SAMPLE_VERTICES = 2000


#: Above this share of vertices left by a matching, single vertices are paired as well.
STALLED = 0.7


@dataclass(frozen=True)
class Level:
    """A graph and the map of its vertices to the next coarser one's (v, cv); None at the coarsest."""

    gv: DataFrame
    ge: DataFrame
    n: int
    cmap: DataFrame | None = None


def edge_length_ref(gv: DataFrame, ge: DataFrame, sample: int = SAMPLE_VERTICES) -> DataFrame:
    """(dref2): mean squared edge length over the edges of the first `sample` vertices; 1 if there is none or it is 0."""
    first = gv.select("v").orderBy("v").limit(sample)
    at = ge.join(F.broadcast(first.withColumnRenamed("v", "src")), "src").join(gv.select(F.col("v").alias("src"), "x", "y", "z"), "src").join(gv.select(F.col("v").alias("dst"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz")), "dst")
    mean = F.sum(d2("x", "y", "z")) / F.count("*")
    return at.agg(mean.alias("m")).select(F.when(F.col("m") >= 1e-20, F.col("m")).otherwise(1.0).alias("dref2"))


def max_edge_weight(ge: DataFrame) -> DataFrame:
    """(max_w): 1 at least."""
    return ge.agg(F.greatest(F.lit(1), F.coalesce(F.max("w"), F.lit(1))).cast("long").alias("max_w"))


def match_scores(gv: DataFrame, ge: DataFrame, lam: float, max_weight: int = 0) -> DataFrame:
    """(src, dst, score): lam * w / max_w + (1 - lam) / (1 + d2 / dref2), for pairs that weigh max_weight at most (0: any)."""
    a = gv.select(F.col("v").alias("src"), F.col("vwgt").alias("w_src"), "x", "y", "z")
    b = gv.select(F.col("v").alias("dst"), F.col("vwgt").alias("w_dst"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    rows = ge.join(a, "src").join(b, "dst").crossJoin(F.broadcast(edge_length_ref(gv, ge))).crossJoin(F.broadcast(max_edge_weight(ge)))
    if max_weight > 0:
        rows = rows.where(F.col("w_src") + F.col("w_dst") <= max_weight)
    return rows.select("src", "dst", (F.lit(lam) * F.col("w") / F.col("max_w") + F.lit(1 - lam) / (1 + d2("x", "y", "z") / F.col("dref2"))).alias("score"))


def edge_hash(seed: int) -> Column:
    """The same number for both directions of an edge."""
    return F.xxhash64(F.lit(seed), F.least("src", "dst"), F.greatest("src", "dst"))


def mutual_best(scored: DataFrame, *tie: Column) -> DataFrame:
    """(v, u): pairs v < u that choose each other as best by score, then by `tie`, then by the lower ids.

    One round; the best edge of all is always mutual, so a round without a pair has no edge left.
    """
    order = F.struct("score", *tie, (-F.least("src", "dst")).alias("lo"), (-F.greatest("src", "dst")).alias("hi"))
    choice = scored.groupBy("src").agg(F.max_by("dst", order).alias("dst")).where("src <> dst")
    # each vertex chooses once, so a pair that is chosen twice is chosen by both; a count needs no join, and no table in the driver
    return choice.groupBy(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).count().where("count = 2").select("v", "u")


def match(gv: DataFrame, scored: DataFrame, seed: int, rounds: int = 8) -> DataFrame:
    """cmap (v, cv) of a matching by rounds of mutual-best pairs among unmatched vertices; cv is the lower id of a pair.

    With rounds enough it is maximal. Equal scores are ordered by a hash of the edge, which keeps chains short.
    """
    left = written(scored)
    pairs = None
    for r in range(rounds):
        found = written(mutual_best(left, edge_hash(seed + r).alias("h")))
        if found.limit(1).count() == 0:
            break
        pairs = found if pairs is None else pairs.unionByName(found)
        used = found.select(F.explode(F.array("v", "u")).alias("v"))
        left = written(left.join(used.toDF("src"), "src", "left_anti").join(used.toDF("dst"), "dst", "left_anti"))
    if pairs is None:
        return gv.select("v", F.col("v").alias("cv"))
    return gv.select("v").join(pairs.select(F.col("u").alias("v"), F.col("v").alias("cv")), "v", "left").select("v", F.coalesce("cv", "v").alias("cv"))


#: Single vertices that one window pairs, about.
PAIR_ROWS = 10_000


def pair_leftovers(gv: DataFrame, ge: DataFrame, cmap: DataFrame, max_weight: int = 0, of: DataFrame | None = None) -> DataFrame:
    """cmap with single vertices paired that share their heaviest neighbour, or that have none: what no matching can merge.

    Pairs are neighbours in the order of ids within the salts of a shared neighbour, of which it has more the more leaves it has, or within
    hash buckets. of (v, sub): only vertices of one sub-problem are paired.
    """
    single = cmap.join(cmap.groupBy("cv").count().where("count = 1").select("cv"), "cv", "left_semi").select("v").join(gv.select("v", "vwgt"), "v")
    single = single.withColumn("sub", F.lit(0)) if of is None else single.join(of, "v")
    heavy = ge.where("src <> dst").groupBy(F.col("src").alias("v")).agg(F.max(F.struct("w", (-F.col("dst")).alias("d")))["d"].alias("near"))
    known = written(single.join(heavy, "v", "left"))
    # of hubs only, by one whole number: the table of a broadcast by two columns takes 17 MB of the driver even if it is empty. Hubs of one hash have more salts
    known = known.withColumn("_hub", F.xxhash64("near", "sub"))
    salts = known.groupBy("_hub").agg(F.ceil(F.count("*") / PAIR_ROWS).alias("salts")).where("salts > 1")
    salted = known.join(F.broadcast(salts), "_hub", "left")
    by = W.partitionBy("sub", "near", "salt").orderBy("v")
    placed = salted.withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)))).withColumn("i", F.row_number().over(by) - 1).withColumn("to", F.lag("v").over(by)).withColumn("w_to", F.lag("vwgt").over(by))
    fits = (F.col("i") % 2 == 1) & ((F.col("vwgt") + F.col("w_to") <= max_weight) if max_weight > 0 else F.lit(True))
    second = placed.where(fits).select("v", "to")
    return cmap.join(second, "v", "left").select("v", F.coalesce("to", "cv").alias("cv"))


def contract_vertices(gv: DataFrame, cmap: DataFrame) -> DataFrame:
    """gv of the coarse graph: weights and sizes summed, coordinates the weighted mean."""
    mean = lambda c: F.when(F.sum("vwgt") > 0, F.sum(F.col("vwgt") * F.col(c)) / F.sum("vwgt")).otherwise(F.sum(c) / F.count("*")).alias(c)
    return gv.join(cmap, "v").groupBy(F.col("cv").alias("v")).agg(F.sum("vwgt").cast("long").alias("vwgt"), F.sum("vsize").cast("long").alias("vsize"), *map(mean, "xyz")).select("v", "vwgt", "vsize", "x", "y", "z")


def contract_edges(ge: DataFrame, cmap: DataFrame, tasks: int = 0) -> DataFrame:
    """ge of the coarse graph: parallel edges summed, edges inside a coarse vertex gone. By so many tasks; 0: as many as Spark takes."""
    dealt = (lambda df, *keys: df.repartition(tasks, *keys)) if tasks else (lambda df, *keys: df)
    half = dealt(dealt(ge, "src").join(cmap.toDF("src", "cs"), "src"), "dst")
    both = dealt(half.join(cmap.toDF("dst", "cd"), "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst"), "w"), "src", "dst")
    return both.groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))


def project(cmap: DataFrame, coarse_part: DataFrame) -> DataFrame:
    """part of the fine graph: each vertex has its coarse vertex's."""
    return cmap.join(coarse_part.withColumnRenamed("v", "cv"), "cv").select("v", "part")


def coarsen(gv: DataFrame, ge: DataFrame, limit: int, ratio: float = 0.75, max_levels: int = 128, seed: int = 42, lam: float = 1.0, max_weight: int = 0, most_edges: int = 0, of: DataFrame | None = None) -> list[Level]:
    """Levels, finest first, until one has `limit` vertices or fewer (and most_edges directed edges, unless that is 0), or a level keeps
    `ratio` of the vertices or more. of (v, sub): the graph is many sub-problems side by side, and no vertices of two are merged."""
    levels = [Level(gv, ge, gv.count())]
    dense = lambda x: most_edges > 0 and x.ge.limit(most_edges + 1).count() > most_edges
    while (levels[-1].n > limit or (levels[-1].n > 1 and dense(levels[-1]))) and len(levels) <= max_levels:
        fine = levels[-1]
        scored = match_scores(fine.gv, fine.ge, lam, max_weight) if lam < 1 else weight_scores(fine.gv, fine.ge, max_weight)
        cmap = written(match(fine.gv, scored, seed + 101 * len(levels)))
        if cmap.where("v = cv").count() > STALLED * fine.n:
            cmap = written(pair_leftovers(fine.gv, fine.ge, cmap, max_weight, of))
        cv, ce = written(contract_vertices(fine.gv, cmap)), written(contract_edges(fine.ge, cmap))
        n = cv.count()
        if n >= fine.n:
            break
        levels[-1] = Level(fine.gv, fine.ge, fine.n, cmap)
        levels.append(Level(cv, ce, n))
        if n / fine.n >= ratio and len(levels) > 2:
            break
    return levels


def weight_scores(gv: DataFrame, ge: DataFrame, max_weight: int = 0) -> DataFrame:
    """(src, dst, score): the edge weight, for pairs that weigh max_weight at most (0: any)."""
    rows = ge
    if max_weight > 0:
        w = gv.select("v", "vwgt")
        rows = ge.join(w.toDF("src", "w_src"), "src").join(w.toDF("dst", "w_dst"), "dst").where(F.col("w_src") + F.col("w_dst") <= max_weight)
    return rows.select("src", "dst", F.col("w").cast("double").alias("score"))
