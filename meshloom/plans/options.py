"""Options of the partitioners; the defaults are a part of their meaning."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BisectOptions:
    target0: int = 0  # 0: half of the weight
    trials: int = 10
    passes: int = 8
    ub: float = 1.03
    seed: int = 42


@dataclass(frozen=True)
class RecursiveOptions:
    k: int = 4
    trials: int = 10
    passes: int = 8
    ub: float = 1.03
    post_refine: str = "cut"  # none, cut, volume, both
    post_passes: int = 10
    seed: int = 42


@dataclass(frozen=True)
class KwayOptions:
    k: int = 4
    coarse_limit: int = 20
    ratio: float = 0.75
    max_levels: int = 128
    init_trials: int = 5
    objective: str = "cut"  # cut, volume
    passes: int = 10
    ub: float = 1.03
    seed: int = 42


@dataclass(frozen=True)
class KMeansOptions:
    max_iterations: int = 100
    tol: float = 1e-4
    ub: float = 1.10
    topo_balance: bool = True
    connectivity: bool = True
    bfs_seeds: bool = True
    seed: int = 42


@dataclass(frozen=True)
class GeoOptions:
    k: int = 4
    coarse_limit: int = 20
    ratio: float = 0.75
    max_levels: int = 128
    lam: float = 0.5  # 1: edge weights alone
    init: str = "kmeans"  # kmeans, rb, hybrid
    kmeans_iterations: int = 100
    init_trials: int = 3
    alpha: float = 0.7  # 1: the cut alone
    beta: float | None = None  # None: calibrated
    passes: int = 10
    ub: float = 1.03
    volume: bool = False
    stop_on_no_cut_gain: bool = False  # rounds end at the first that doesn't lower the cut
    connectivity: bool = True
    weight_cap: float = 1.5  # of a part's ideal weight; 0: none
    bfs_seeds: bool = True
    topo_balance: bool = True
    seed: int = 42


#: Five settings: none of the features, one at a time, all.
ABLATION = {
    "baseline": {"bfs_seeds": False, "topo_balance": False, "weight_cap": 0.0, "connectivity": False},
    "bfs": {"bfs_seeds": True, "topo_balance": False, "weight_cap": 0.0, "connectivity": False},
    "topo": {"bfs_seeds": False, "topo_balance": True, "weight_cap": 0.0, "connectivity": False},
    "cap": {"bfs_seeds": False, "topo_balance": False, "weight_cap": 1.5, "connectivity": False},
    "all": {},
}
