"""Partitioners: bisection, recursive bisection, k-means, multilevel k-way, geometric multilevel k-way.

A graph that fits one task is solved there, a task a trial. A larger one is coarsened by DataFrame rounds until it fits,
solved, projected back level by level, and refined by rounds of independent moves on each level: all trials side by side, of which the
best on the finest level is then balanced and refined for its objective.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators import coarsen as co
from meshloom.operators import kernel, kmeans, metrics, refine, repair
from meshloom.operators import trials as side
from meshloom.shared import written

from . import recursion, small
from .options import BisectOptions, GeoOptions, KMeansOptions, KwayOptions, RecursiveOptions


#: Tentative batches of moves that lose, on each level of a graph above one task's size.
CLIMB = 4
#: Rounds in which all trials are refined side by side, on each level of such a graph.
TRIAL_ROUNDS = 4
#: Vertices a part that the coarsest graph has at least, for a k-way start on it.
VERTICES_A_PART = 20


@dataclass(frozen=True)
class Partitioned:
    """part(v, part); stats: one row of metrics.partition_stats; levels of coarsening; inertia of the k-means start."""

    part: DataFrame
    stats: DataFrame
    levels: int
    inertia: float = 0.0


def _done(gv: DataFrame, ge: DataFrame, part: DataFrame, k: int, ub: float, levels: int = 1, inertia: float = 0.0) -> Partitioned:
    return Partitioned(part, metrics.partition_stats(gv, ge, part, k, ub), levels, inertia)


def bisect(gv: DataFrame, ge: DataFrame, o: BisectOptions = BisectOptions(), most: int = 0) -> Partitioned:
    """Two parts; a trial a task. target0 is the first part's weight, half of all if it is 0. On a graph above one task's size rounds
    balance and refine towards both targets on each level."""
    most = most or small.MOST_VERTICES
    if o.target0 and not small.fits(gv, ge, most):
        total = gv.agg(F.sum("vwgt")).first()[0]
        of = gv.select("v", F.lit(0).alias("sub"))
        side = recursion.bisect_all(gv, ge, of, {0: recursion.halves(0, 2, min(1.0, o.target0 / total))}, o.trials, o.passes, o.ub, o.seed, most, CLIMB)
        return _done(gv, ge, side.select("v", F.col("side").alias("part")), 2, o.ub, 2)

    def solver(g: kernel.Graph, seed: int) -> tuple[list[int], float]:
        t1 = max(g.total - (o.target0 or g.total // 2), 1)
        return kernel.bisect(g, (g.total - t1, t1), 1, o.passes, o.ub, seed), 0.0

    trials = [o.seed * 1009 + t for t in range(o.trials)]
    return _multilevel(gv, ge, 2, o.ub, most, solver, trials, o.seed, o.passes)


def recursive_bisect(gv: DataFrame, ge: DataFrame, o: RecursiveOptions = RecursiveOptions(), most: int = 0) -> Partitioned:
    """k parts by halving, then refined for the cut, the boundary volume, both or neither. Above one task's size all sub-problems of a depth
    are halved at once (plans.recursion), until each fits a task."""
    most = most or small.MOST_VERTICES
    if not small.fits(gv, ge, most):
        part, depth = recursion.recursive_parts(gv, ge, o.k, o.trials, o.passes, o.ub, o.seed, most, CLIMB)
        for mode in {"cut": ("cut",), "volume": ("volume",), "both": ("cut", "volume")}.get(o.post_refine, ()):
            part = refine.refine(gv, ge, part, o.k, o.ub, o.post_passes, mode, seed=o.seed, climb=CLIMB).part
        return _done(gv, ge, part, o.k, o.ub, 1 + depth)

    def solver(g: kernel.Graph, seed: int) -> tuple[list[int], float]:
        where = kernel.recursive_bisection(g, o.k, o.trials, o.passes, o.ub, seed)
        if o.post_refine in ("cut", "both"):
            kernel.refine(g, where, o.k, o.ub, o.post_passes)
        if o.post_refine in ("volume", "both"):
            kernel.refine(g, where, o.k, o.ub, o.post_passes, volume=True)
        return where, 0.0

    part, _ = small.solve(gv, ge, solver, [o.seed], o.k, o.ub)
    return _done(gv, ge, part, o.k, o.ub)


def kmeans_partition(gv: DataFrame, ge: DataFrame, k: int, o: KMeansOptions = KMeansOptions(), most: int = small.MOST_VERTICES) -> Partitioned:
    """k-means parts, balanced and connected. Above one task's size the seeds' regions are grown on a coarse graph that fits one, and
    their centres start Lloyd's iterations over all vertices; rounds do the rest."""
    if small.fits(gv, ge, most):

        def solver(g: kernel.Graph, seed: int) -> tuple[list[int], float]:
            where, inertia = kernel.kmeans(g, k, seed, o.max_iterations, o.tol, o.bfs_seeds)
            kernel.balance(g, where, k, o.ub) if o.topo_balance else kernel.geometric_balance(g, where, k, o.ub)
            if o.connectivity:
                kernel.connect(g, where, k, o.ub)
            return where, inertia

        part, inertia = small.solve(gv, ge, solver, [o.seed], k, o.ub)
        return _done(gv, ge, part, k, o.ub, inertia=inertia)
    start = None
    if o.bfs_seeds:
        levels = _coarse(gv, ge, k, most, 0.95, 128, o.seed, 0.5, 0)
        part, _ = _solved(levels[-1], lambda g, seed: (kernel.grown(g, k, seed), 0.0), [o.seed], k, o.ub)
        for fine in reversed(levels[:-1]):
            part = written(co.project(fine.cmap, part))
        start = [(r["part"], r["cx"], r["cy"], r["cz"]) for r in kmeans.centroids(gv, part, k).collect()]  # k rows
    run = kmeans.kmeans(gv, k, o.seed, o.max_iterations, o.tol, start)
    part = (refine.balance if o.topo_balance else refine.geometric_balance)(gv, ge, run.part, k, o.ub).part
    if o.connectivity:
        part = repair.enforce_connectivity(gv, ge, part, k, o.ub).part
    return _done(gv, ge, part, k, o.ub, inertia=run.inertia)


def kway_partition(gv: DataFrame, ge: DataFrame, o: KwayOptions = KwayOptions(), most: int = small.MOST_VERTICES) -> Partitioned:
    """Multilevel k-way partition by edge weights alone."""
    if o.k == 1:
        return _done(gv, ge, gv.select("v", F.lit(0).alias("part")), 1, o.ub)

    def solver(g: kernel.Graph, seed: int) -> tuple[list[int], float]:
        return kernel.multilevel(g, o.k, seed, o.ub, o.passes, init="rb", coarse_limit=o.coarse_limit, ratio=o.ratio, trials=1, volume=o.objective == "volume")

    return _multilevel(gv, ge, o.k, o.ub, most, solver, _trials(o), o.seed, o.passes, mode=o.objective, ratio=o.ratio, max_levels=o.max_levels)


def geo_kway_partition(gv: DataFrame, ge: DataFrame, o: GeoOptions = GeoOptions(), most: int = small.MOST_VERTICES) -> Partitioned:
    """Multilevel k-way partition led by coordinates: matching, start and gains mix edge weights with distances."""
    if o.k == 1:
        return _done(gv, ge, gv.select("v", F.lit(0).alias("part")), 1, o.ub)

    def solver(g: kernel.Graph, seed: int) -> tuple[list[int], float]:
        return kernel.multilevel(
            g, o.k, seed, o.ub, o.passes, lam=o.lam, alpha=o.alpha, cap_factor=o.weight_cap, init=o.init, coarse_limit=o.coarse_limit, ratio=o.ratio, trials=1,
            iterations=o.kmeans_iterations, bfs=o.bfs_seeds, topo_balance=o.topo_balance, connectivity=o.connectivity, volume=o.volume, beta=o.beta,
        )

    total = gv.agg(F.coalesce(F.sum("vwgt"), F.lit(0))).first()[0]
    cap = int(total / o.k * o.weight_cap + 0.5)
    return _multilevel(gv, ge, o.k, o.ub, most, solver, _trials(o), o.seed, o.passes, "volume" if o.volume else "cut", o.ratio, o.max_levels, o.lam, cap, o.alpha, o.beta, o.connectivity, o.stop_on_no_cut_gain)


def _trials(o: KwayOptions | GeoOptions) -> list[int]:
    """A seed a trial; each trial is a task that coarsens, starts and refines by itself."""
    return [o.seed * 1009 + t for t in range(max(1, o.init_trials))]


def _coarse(gv: DataFrame, ge: DataFrame, k: int, most: int, ratio: float, max_levels: int, seed: int, lam: float, cap: int) -> list[co.Level]:
    """Levels down to one that fits a task, by its vertices and by its edges."""
    return co.coarsen(gv, ge, most, ratio, max_levels, seed, lam, cap, 0 if small.fits(gv, ge, most) else small.MOST_EDGES)


def _solved(coarse: co.Level, solver: small.Solver, trials: list[int], k: int, ub: float) -> tuple[DataFrame, float]:
    """The best trial over a level that fits a task. Where no matching makes a graph that small (weight caps, for one), k-means over its
    points is the start."""
    if small.fits(coarse.gv, coarse.ge, small.MOST_VERTICES):
        return small.solve(coarse.gv, coarse.ge, solver, trials, k, ub)
    run = kmeans.kmeans(coarse.gv, k, trials[0])
    return refine.balance(coarse.gv, coarse.ge, run.part, k, ub, seed=trials[0]).part, run.inertia


def _best_projected(levels: list[co.Level], solver: small.Solver, trials: list[int], k: int, ub: float, seed: int) -> tuple[DataFrame, float]:
    """The best of the trials once all are projected to the finest level, side by side, and refined on each; and its inertia."""
    labels, inertias = small.solve_each(levels[-1].gv, levels[-1].ge, solver, trials, k, ub)
    for fine in reversed(levels[:-1]):
        tried = side.refine(fine.gv, fine.ge, side.project(fine.cmap, labels), len(trials), k, ub, TRIAL_ROUNDS, seed)
        labels = tried.labels
    chosen = side.best(levels[0].gv, tried, k, ub)
    return written(side.part_of(labels, chosen)), inertias[chosen]


def _multilevel(
    gv: DataFrame, ge: DataFrame, k: int, ub: float, most: int, solver: small.Solver, trials: list[int], seed: int, rounds: int, mode: str = "cut", ratio: float = 0.75, max_levels: int = 128,
    lam: float = 1.0, cap: int = 0, alpha: float = 1.0, beta: float | None = None, connectivity: bool = False, stop: bool = False,
) -> Partitioned:
    if k * VERTICES_A_PART > most and not small.fits(gv, ge, most):
        # more parts than a coarse graph of one task can start: halve until they fit
        part, depth = recursion.recursive_parts(gv, ge, k, 1, rounds, ub, seed, most, CLIMB)
        part = refine.balance(gv, ge, part, k, ub, seed=seed).part
        part = refine.refine(gv, ge, part, k, ub, rounds, mode, alpha, beta, seed, stop, climb=CLIMB).part
        return _done(gv, ge, part, k, ub, 1 + depth)
    levels = _coarse(gv, ge, k, most, 1.0 if ratio >= 1 else max(ratio, 0.95), max_levels, seed, lam, cap)
    several = len(trials) > 1 and len(levels) > 1 and small.fits(levels[-1].gv, levels[-1].ge, small.MOST_VERTICES)
    if several:
        part, inertia = _best_projected(levels, solver, trials, k, ub, seed)
    else:
        part, inertia = _solved(levels[-1], solver, trials, k, ub)
    for fine in levels[:1] if several else reversed(levels[:-1]):
        part = part if several else written(co.project(fine.cmap, part))
        part = refine.balance(fine.gv, fine.ge, part, k, ub, seed=seed).part
        part = refine.refine(fine.gv, fine.ge, part, k, ub, rounds, mode, alpha, beta, seed, stop, climb=CLIMB if fine is levels[0] else 0).part
    if connectivity and len(levels) > 1:
        for _ in range(3):
            fixed = repair.enforce_connectivity(gv, ge, part, k, ub * 1.10)
            even = refine.balance(gv, ge, fixed.part, k, ub, seed=seed)
            part = even.part
            if not fixed.vertices_moved and not even.moves:
                break
            part = refine.refine(gv, ge, part, k, ub, max(2, rounds // 2), "cut", seed=seed).part
    return _done(gv, ge, part, k, ub, len(levels), inertia)
