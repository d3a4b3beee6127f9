"""Recursive bisection of graphs that fit no task: all sub-problems of a depth are one table, keyed by sub-problem.

Sub-problems that are too large for a task are halved together: coarsened side by side, each solved in a group of its own, projected
back and refined by the same rounds. Once a sub-problem fits a task, all its further halvings are done in its group. So depths that take Spark
jobs are the logarithm of vertices over a task's size, whatever the number of parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators import coarsen as co
from meshloom.operators import kernel, refine
from meshloom.operators.prefix import prefix_sums
from meshloom.shared import scratch, written

from . import small

#: Rounds of moves on each level, before a climb on the finest.
ROUNDS = 4


@dataclass(frozen=True)
class Sub:
    """A sub-problem: its parts are first to first + parts - 1; share of its weight that the first half aims at."""

    first: int
    parts: int
    share: float


def halves(first: int, parts: int, share: float | None = None) -> Sub:
    return Sub(first, parts, parts // 2 / parts if share is None else share)


def within(ge: DataFrame, of: DataFrame) -> DataFrame:
    """ge of the edges whose ends are of one sub-problem; of (v, sub)."""
    return ge.join(of.toDF("src", "_s"), "src").join(of.toDF("dst", "_d"), "dst").where("_s = _d").select("src", "dst", "w")


def _sizes(gv: DataFrame, ge: DataFrame, of: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Vertices, directed edges and weight of each sub-problem; a row for each of them."""
    n = of.join(gv.select("v", "vwgt"), "v").groupBy("sub").agg(F.count("*").alias("n"), F.sum("vwgt").alias("w"))
    e = ge.join(of.toDF("src", "sub"), "src").groupBy("sub").agg(F.count("*").alias("e"))
    return {r["sub"]: (r["n"], r["e"] or 0, r["w"]) for r in n.join(e, "sub", "left").collect()}


def solve_groups(gv: DataFrame, ge: DataFrame, of: DataFrame, solver, form: str = "side int") -> DataFrame:  # noqa: ANN001
    """(v, side), written: each sub-problem's graph in a group of its own; solver(graph, sub) gives a number a vertex. ge: edges within them."""
    zero = F.lit(0.0)
    vertices = gv.join(of, "v").select("sub", F.lit(0).alias("kind"), F.col("v").alias("a"), F.col("vwgt").alias("b"), F.col("vsize").alias("w"), "x", "y", "z")
    edges = ge.where("src <> dst").join(of.toDF("src", "sub"), "src").select("sub", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w", zero.alias("x"), zero.alias("y"), zero.alias("z"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, ids = small.graph_of(rows)
        return pd.DataFrame({"v": ids, "side": np.array(solver(g, int(key[0])), np.int32)})

    return written(vertices.unionByName(edges).groupBy("sub").applyInPandas(run, f"v long, {form}"))


def _split_by_place(gv: DataFrame, of: DataFrame, subs: dict[int, Sub]) -> DataFrame:
    """(v, side): each sub-problem cut at its share in the order of (x, y, z, v); the start where no coarsening makes it fit a task."""
    rows = prefix_sums(gv.join(of, "v"), ["x", "y", "z", "v"], "vwgt", "upto", ["sub"])
    total = F.broadcast(gv.join(of, "v").groupBy("sub").agg(F.sum("vwgt").alias("total")))
    share = F.broadcast(gv.sparkSession.createDataFrame([(s, x.share) for s, x in subs.items()], "sub int, share double"))
    return written(rows.join(total, "sub").join(share, "sub").select("v", (F.col("upto") >= F.col("share") * F.col("total")).cast("int").alias("side")))


def bisect_all(gv: DataFrame, ge: DataFrame, of: DataFrame, subs: dict[int, Sub], trials: int, passes: int, ub: float, seed: int, most: int, climb: int = 0) -> DataFrame:
    """(v, side), written, for the vertices of the sub-problems `subs`, all of them halved at once. of (v, sub) names others too."""
    spark = gv.sparkSession
    named = F.broadcast(spark.createDataFrame([(s,) for s in subs], "sub int"))
    with scratch(spark) as keep:
        of = written(of.join(named, "sub").select("v", "sub"))
        gv, ge = written(gv.join(of.select("v"), "v", "left_semi")), written(within(ge, of))
        levels = [co.Level(gv, ge, gv.count())]
        limit = max(2, int(0.8 * most * len(subs)))
        while True:
            coarse = levels[-1]
            at = of.join(coarse.gv.select("v"), "v", "left_semi")  # a coarse vertex has the id of one of its own
            sizes = _sizes(coarse.gv, coarse.ge, at)
            fit = all(n <= most and e <= small.MOST_EDGES for n, e, _ in sizes.values())
            if fit or coarse.n < 4 * len(subs):
                break
            more = co.coarsen(coarse.gv, coarse.ge, min(limit, coarse.n - 1), 0.98, 128, seed + len(levels), of=of)
            if len(more) == 1:
                break
            levels = levels[:-1] + more
            limit = max(2, limit // 2)
        share = {s: x.share for s, x in subs.items()}

        def solver(g: kernel.Graph, sub: int) -> list[int]:
            t0 = max(1, int(share[sub] * g.total + 0.5))
            return kernel.bisect(g, (t0, max(1, g.total - t0)), trials, passes, ub, seed * 31 + sub)

        side = solve_groups(coarse.gv, coarse.ge, at, solver) if fit else _split_by_place(coarse.gv, at, subs)
        # halves are parts of one graph: sub-problem i has 2 i and 2 i + 1
        number = {s: i for i, s in enumerate(sorted(subs))}
        index = F.broadcast(spark.createDataFrame(list(number.items()), "sub int, i int"))
        part = written(side.join(of.join(index, "sub"), "v").select("v", (2 * F.col("i") + F.col("side")).cast("int").alias("part")))
        targets = {2 * number[s] + h: (share[s] if h == 0 else 1 - share[s]) * w for s, (_, _, w) in sizes.items() for h in (0, 1)}
        k = 2 * len(subs)
        for fine in reversed(levels[:-1]):
            part = written(co.project(fine.cmap, part))
            part = refine.balance(fine.gv, fine.ge, part, k, ub, seed=seed, targets=targets).part
            part = refine.refine(fine.gv, fine.ge, part, k, ub, min(passes, ROUNDS), seed=seed, targets=targets, climb=climb if fine is levels[0] else 0).part
        if not fit and len(levels) == 1:
            part = refine.refine(gv, ge, part, k, ub, min(passes, ROUNDS), seed=seed, targets=targets, climb=climb).part
        return keep(written(part.select("v", F.pmod("part", F.lit(2)).cast("int").alias("side"))))


def recursive_parts(gv: DataFrame, ge: DataFrame, k: int, trials: int, passes: int, ub: float, seed: int, most: int, climb: int = 0) -> tuple[DataFrame, int]:
    """(v, part), written, of k parts by halving, and the number of depths that were done by rounds. The driver holds a row a sub-problem."""
    spark = gv.sparkSession
    with scratch(spark) as keep:
        subs = {0: halves(0, k)}
        of, depth = written(gv.select("v", F.lit(0).alias("sub"))), 0
        while True:
            sizes = _sizes(gv, within(ge, of), of)
            large = {s: subs[s] for s, (n, e, _) in sizes.items() if subs[s].parts > 1 and (n > most or e > small.MOST_EDGES)}
            if not large:
                break
            side = bisect_all(gv, ge, of, large, trials, passes, ub, seed + depth, most, climb)
            new: dict[int, Sub] = {}
            number = {}
            for s, x in sorted(subs.items()):
                for h in (0, 1) if s in large else (0,):
                    number[s, h] = len(new)
                    left = x.parts // 2
                    new[len(new)] = x if s not in large else halves(x.first, left) if h == 0 else halves(x.first + left, x.parts - left)
            names = F.broadcast(spark.createDataFrame([(s, h, i) for (s, h), i in number.items()], "sub int, side int, to int"))
            of = written(of.join(side, "v", "left").select("v", "sub", F.coalesce("side", F.lit(0)).alias("side")).join(names, ["sub", "side"]).select("v", F.col("to").alias("sub")))
            subs, depth = new, depth + 1

        def solver(g: kernel.Graph, sub: int) -> list[int]:
            x = subs[sub]
            return [x.first + p for p in kernel.recursive_bisection(g, x.parts, trials, passes, ub, seed * 31 + sub)]

        done = F.broadcast(spark.createDataFrame([(s, x.first) for s, x in subs.items() if x.parts == 1], "sub int, part int"))
        more = F.broadcast(spark.createDataFrame([(s,) for s, x in subs.items() if x.parts > 1], "sub int"))
        todo = written(of.join(more, "sub").select("v", "sub"))
        solved = solve_groups(gv, within(ge, todo), todo, solver).select("v", F.col("side").alias("part"))
        return keep(written(of.join(done, "sub").select("v", "part").unionByName(solved))), depth
