"""Command line: partition a mesh file, or report on a partition of it."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshloom.operators import dual, metrics
from meshloom.plans import partition as plans
from meshloom.plans.options import GeoOptions, KwayOptions, RecursiveOptions
from meshloom.sources.mesh_text import read_mesh
from meshloom.sources.msh41 import read_msh
from meshloom.sources.part_file import read_parts, write_parts


def _number(kind: type, low: float, high: float = float("inf")) -> Callable[[str], float]:
    """A number of this kind from low to high, for argparse."""

    def read(text: str) -> float:
        x = kind(text)
        if not low <= x <= high:
            raise argparse.ArgumentTypeError(f"{x} isn't from {low} to {high}")
        return x

    read.__name__ = kind.__name__
    return read


def _mark(parser: argparse.ArgumentParser, namespace: argparse.Namespace, name: str, option: str | None) -> None:
    """An error for an option that is given twice, of which one value would be lost."""
    seen = vars(namespace).setdefault("given", set())
    if name in seen:
        parser.error(f"{option} is given twice")
    seen.add(name)


class _Once(argparse.Action):
    def __call__(self, parser, namespace, values, option_string=None) -> None:  # noqa: ANN001
        _mark(parser, namespace, self.dest, option_string)
        setattr(namespace, self.dest, values)


class _OnceYesNo(argparse.BooleanOptionalAction):
    def __call__(self, parser, namespace, values, option_string=None) -> None:  # noqa: ANN001
        _mark(parser, namespace, self.dest, option_string)
        super().__call__(parser, namespace, values, option_string)


def parser() -> argparse.ArgumentParser:
    """Lists are words on one option; of the runs that they make the best is kept: balanced first, then of least cut."""
    p = argparse.ArgumentParser(prog="meshloom", description=__doc__)
    p.register("action", None, _Once)
    yes_no = _OnceYesNo
    p.add_argument("mesh", help="mesh text file, or .msh")
    p.add_argument("-k", "--parts", type=_number(int, 1), default=4)
    p.add_argument("-w", "--method", choices=("geo", "kway", "rb"), default="geo")
    p.add_argument("-o", "--out", help="binary partition file to write")
    p.add_argument("-r", "--report", metavar="FILE", help="report on this partition file instead of partitioning")
    p.add_argument("--seed", type=_number(int, 0), nargs="+", default=[42])
    p.add_argument("--ub", type=_number(float, 1), default=1.03, help="a part weighs at most this times the ideal")
    p.add_argument("--alpha", type=_number(float, 0, 1), nargs="+", default=[0.7], help="share of the cut in the gain; the rest is distance")
    p.add_argument("--objective", choices=("cut", "volume"), default="cut")
    p.add_argument("--stop-on-no-cut-gain", action=yes_no, default=False, help="end refinement at the first round that doesn't lower the cut")
    p.add_argument("--connectivity", action=yes_no, default=True, help="move islands of a part to a neighbour")
    p.add_argument("--bfs-seeds", action=yes_no, default=True, help="grow k-means seeds by breadth")
    p.add_argument("--topo-balance", action=yes_no, default=True, help="balance by edges, not by distance")
    p.add_argument("--weight-cap", type=_number(float, 0), default=1.5, help="of a coarse vertex, times a part's ideal weight; 0: none")
    p.add_argument("--levels", type=_number(int, 1), default=128, help="most levels of coarsening")
    p.add_argument("--init", choices=("kmeans", "rb", "hybrid"), default="kmeans")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meshloom").getOrCreate()
    if a.mesh.endswith(".msh"):
        mesh = read_msh(spark, a.mesh)
        dual.supported_gmsh(mesh.elements)
        kinds = {r[0] for r in mesh.elements.select("gmsh_type").distinct().collect()}
        dim = 2 if kinds <= {2, 3} else 3
    else:
        mesh = read_mesh(spark, a.mesh)
        dim = mesh.dimension
        dual.supported(mesh.elements)
    gv, ge = dual.element_graph(mesh.elements, mesh.vertices, dim)
    if a.report:
        found = metrics.partition_stats(gv, ge, read_parts(spark, a.report), a.parts, a.ub).first().asDict()
    else:
        runs = [_run(gv, ge, a, seed, alpha) for seed in a.seed for alpha in (a.alpha if a.method == "geo" else a.alpha[:1])]
        done, found = min(((x, x.stats.first().asDict()) for x in runs), key=lambda x: (not x[1]["balanced"], x[1]["cut"]))
        if a.out:
            write_parts(done.part, a.parts, a.out)
    for name, value in found.items():
        print(f"{name}: {value}")
    return found


def _run(gv: DataFrame, ge: DataFrame, a: argparse.Namespace, seed: int, alpha: float) -> plans.Partitioned:
    common = {"k": a.parts, "ub": a.ub, "seed": seed}
    if a.method == "kway":
        return plans.kway_partition(gv, ge, KwayOptions(**common, objective=a.objective, max_levels=a.levels))
    if a.method == "rb":
        return plans.recursive_bisect(gv, ge, RecursiveOptions(**common, post_refine=a.objective))
    more = GeoOptions(
        **common, alpha=alpha, init=a.init, volume=a.objective == "volume", max_levels=a.levels, stop_on_no_cut_gain=a.stop_on_no_cut_gain, connectivity=a.connectivity,
        bfs_seeds=a.bfs_seeds, topo_balance=a.topo_balance, weight_cap=a.weight_cap,
    )
    return plans.geo_kway_partition(gv, ge, more)


if __name__ == "__main__":
    main()
