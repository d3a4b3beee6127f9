"""Runs the in-memory algorithms on one bounded graph: a group a trial, the best trial kept."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.kernel import Graph
from meshloom.operators.trials import side_by_side
from meshloom.shared import written

#: A graph of more vertices or directed edges is never sent to one task.
MOST_VERTICES = 20_000
MOST_EDGES = 2_000_000

Solver = Callable[[Graph, int], tuple[list[int], float]]


def fits(gv: DataFrame, ge: DataFrame, most: int = MOST_VERTICES) -> bool:
    return gv.limit(most + 1).count() <= most and ge.limit(MOST_EDGES + 1).count() <= MOST_EDGES


def graph_of(rows: pd.DataFrame) -> tuple[Graph, np.ndarray]:
    """The graph of rows (kind 0: a vertex a with weight b, size w and a point; kind 1: an edge a, b of weight w), and its ids."""
    v = rows[rows["kind"] == 0].sort_values("a")
    ids = v["a"].to_numpy()
    e = rows[rows["kind"] == 1].sort_values(["a", "b"])
    near: list[dict[int, int]] = [{} for _ in ids]
    src, dst = np.searchsorted(ids, e["a"].to_numpy()), np.searchsorted(ids, e["b"].to_numpy())
    for a, b, w in zip(src.tolist(), dst.tolist(), e["w"].tolist(), strict=True):
        near[a][b] = int(w)
    return Graph(near, v["b"].astype(int).tolist(), v["w"].astype(int).tolist(), v[["x", "y", "z"]].fillna(0.0).to_numpy(float)), ids


def _tried(gv: DataFrame, ge: DataFrame, solver: Solver, trials: list[int], k: int, ub: float) -> tuple[DataFrame, list]:
    """(trial, v, part, ...) of all trials (seeds), written, and a row a trial: whether it is over ub, its cut and inertia.

    Each trial has a copy of the bounded graph in a task of its own; the driver reads a row a trial.
    """
    if not fits(gv, ge):
        raise ValueError(f"over {MOST_VERTICES} vertices or {MOST_EDGES} edges: coarsen the graph first")
    zero = F.lit(0.0)
    vertices = gv.select(F.lit(0).alias("kind"), F.col("v").alias("a"), F.col("vwgt").alias("b"), F.col("vsize").alias("w"), "x", "y", "z")
    edges = ge.where("src <> dst").select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w", zero.alias("x"), zero.alias("y"), zero.alias("z"))
    each = vertices.unionByName(edges).withColumn("trial", F.explode(F.array(*map(F.lit, trials))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, ids = graph_of(rows)
        where, inertia = solver(g, int(key[0]))
        return pd.DataFrame({"trial": int(key[0]), "v": ids, "part": np.array(where, np.int32), "over": g.imbalance(where, k) + 1 > ub + 1e-9, "cut": g.cut(where), "inertia": inertia})

    out = written(each.groupBy("trial").applyInPandas(run, "trial int, v long, part int, over boolean, cut long, inertia double"))
    return out, out.groupBy("trial").agg(F.first("over").alias("over"), F.first("cut").alias("cut"), F.first("inertia").alias("inertia")).collect()


def solve(gv: DataFrame, ge: DataFrame, solver: Solver, trials: list[int], k: int, ub: float) -> tuple[DataFrame, float]:
    """part of the best of the trials (seeds), and its inertia: within ub first, then of least cut, then the first."""
    out, tried = _tried(gv, ge, solver, trials, k, ub)
    if not tried:
        return out.select("v", "part"), 0.0
    best = min(tried, key=lambda r: (r["over"], r["cut"], r["trial"]))
    return out.where(F.col("trial") == best["trial"]).select("v", "part"), float(best["inertia"])


def solve_each(gv: DataFrame, ge: DataFrame, solver: Solver, trials: list[int], k: int, ub: float) -> tuple[DataFrame, list[float]]:
    """labels of all trials (rising seeds) side by side, and the inertia of each."""
    out, tried = _tried(gv, ge, solver, trials, k, ub)
    return side_by_side(out), [float(r["inertia"]) for r in sorted(tried, key=lambda r: r["trial"])]
