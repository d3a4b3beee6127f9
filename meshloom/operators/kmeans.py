"""Geometry of parts: centroids, nearest centres, Lloyd iterations, k-means++ seeds, hybrid gains.

cent(part, cx, cy, cz) has a row a part, so it is small by the number of parts and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.geometry import d2
from meshloom.shared import scratch, written

from .metrics import links, moves_of


#: Centres that one expression of distances has, at most, while they are drawn one by one.
SEEDS_A_TABLE = 16
#: Up to so many seeds are drawn one by one, a pass each; more are oversampled.
MOST_SEED_PASSES = 16
OVERSAMPLING_ROUNDS = 5
#: From so many centres on, iterations keep bounds of distances.
BOUNDS_FROM = 64
#: Vertices whose distances to all centres a task holds at once.
SOURCE_ROWS = 1024


@dataclass(frozen=True)
class KMeansRun:
    part: DataFrame
    cent: DataFrame
    inertia: float
    iterations: int
    converged: bool
    #: Distances between a vertex and a centre that were worked out.
    looked: int = 0


def centroids(gv: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(part, cx, cy, cz, w) for all k parts: means weighted by vwgt; an empty part is at the origin and weighs 0."""
    mean = [(F.sum(F.col("vwgt") * F.col(c)) / F.sum("vwgt")).alias(f"c{c}") for c in "xyz"]
    have = gv.join(part, "v").groupBy("part").agg(*mean, F.sum("vwgt").cast("long").alias("w"))
    every = gv.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    return every.join(have, "part", "left").select("part", *[F.coalesce(f"c{c}", F.lit(0.0)).alias(f"c{c}") for c in "xyz"], F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def nearest(gv: DataFrame, cent: DataFrame) -> DataFrame:
    """gv with part and d2: each vertex's nearest centre; ties to the lower part. All centres are one broadcast row, an array of k."""
    every = cent.agg(F.collect_list(F.struct("part", "cx", "cy", "cz")).alias("_cent"))
    far = F.transform("_cent", lambda c: F.struct(sum(((F.col(a) - c[f"c{a}"]) * (F.col(a) - c[f"c{a}"]) for a in "yz"), (F.col("x") - c["cx"]) * (F.col("x") - c["cx"])).alias("d2"), c["part"].alias("part")))
    return gv.crossJoin(F.broadcast(every)).withColumn("_c", F.array_min(far)).select(*gv.columns, F.col("_c.part").alias("part"), F.col("_c.d2").alias("d2"))


Centres = list[tuple[int, float, float, float]]


def one_row(spark: SparkSession, centres: Centres) -> DataFrame:
    """_cent: all centres as one array, to be broadcast; so no expression has a term for each of them."""
    return F.broadcast(spark.createDataFrame([([tuple(c) for c in centres],)], "_cent array<struct<part: int, cx: double, cy: double, cz: double>>"))


def _distances(centres: Column | str = "_cent") -> Column:
    """An array of (d2, part), one for each centre."""
    return F.transform(centres, lambda c: F.struct(_to(c).alias("d2"), c["part"].alias("part")))


def _to(c: Column) -> Column:
    """Squared distance of the row's point from the centre c."""
    return (F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"]) + (F.col("z") - c["cz"]) * (F.col("z") - c["cz"])


def assigned(gv: DataFrame, centres: Centres) -> DataFrame:
    """(v, part, d2, vwgt, x, y, z): nearest() with centres that the driver holds."""
    near = gv.crossJoin(one_row(gv.sparkSession, centres)).withColumn("_c", F.array_min(_distances()))
    return near.select("v", F.col("_c.part").alias("part"), F.col("_c.d2").alias("d2"), "vwgt", "x", "y", "z")


def _point_d2(cx: float, cy: float, cz: float) -> Column:
    parts = [(F.col(a) - F.lit(float(c))) * (F.col(a) - F.lit(float(c))) for a, c in zip("xyz", (cx, cy, cz), strict=True)]
    return parts[0] + parts[1] + parts[2]


def lloyd_step(gv: DataFrame, cent: DataFrame) -> DataFrame:
    """(part, cx, cy, cz, w, inertia): centres after one assignment and update.

    inertia: the part's sum of squared distances to the old centres, without weights. A part that gets no vertex keeps its centre.
    """
    got = nearest(gv, cent).groupBy("part").agg(
        *[(F.sum(F.col("vwgt") * F.col(c)) / F.sum("vwgt")).alias(f"n{c}") for c in "xyz"], F.sum("vwgt").cast("long").alias("nw"), F.sum("d2").alias("inertia")
    )
    rows = cent.join(got, "part", "left")
    return rows.select("part", *[F.coalesce(f"n{c}", f"c{c}").alias(f"c{c}") for c in "xyz"], F.coalesce("nw", F.lit(0)).cast("long").alias("w"), F.coalesce("inertia", F.lit(0.0)).alias("inertia"))


def seeds(gv: DataFrame, k: int, seed: int) -> list[tuple[int, float, float, float]]:
    """k-means++: a vertex drawn with a probability in proportion to its squared distance to the nearest centre so far.

    The draw is an exponential race: the least of -ln(u) / d2, with u from a hash of the id. If all distances are 0, any vertex.
    The driver reads a row for each centre. After every SEEDS_A_TABLE centres the distances so far are written, so that the expression
    doesn't grow with k.
    """
    out: list[tuple[int, float, float, float]] = []
    at, fresh = gv.select("v", "x", "y", "z", F.lit(float("inf")).alias("near")), []
    for i in range(k):
        near = F.least("near", *[_point_d2(*c[1:]) for c in fresh]) if fresh else F.col("near")
        if len(fresh) == SEEDS_A_TABLE:
            at, fresh, near = written(at.withColumn("near", near)), [], F.col("near")
        near = F.lit(1.0) if not out else near
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("v")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        race = F.when(near > 0, -F.log(u) / near)
        row = at.select("v", "x", "y", "z", race.alias("r"), u.alias("u")).agg(F.min(F.struct(F.col("r").isNull(), "r", "u", "v", "x", "y", "z")).alias("b")).first()["b"]
        if row is None:
            break
        out.append((i, row["x"], row["y"], row["z"]))
        fresh.append(out[-1])
    return out


def oversampled_seeds(gv: DataFrame, k: int, seed: int, rounds: int = OVERSAMPLING_ROUNDS) -> Centres:
    """k-means||: seeds in a number of passes that doesn't grow with k.

    Each round draws every vertex with a probability of 2 k times its share of all squared distances to the candidates so far. Candidates, about
    2 k a round, weigh as many vertices as they are nearest to; k-means++ over these weighted points, on the driver, gives k of them, each the
    best of a few draws.
    """
    spark = gv.sparkSession
    uniform = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("v")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    first = gv.select("v", "x", "y", "z", uniform(-1).alias("u")).orderBy("u", "v").limit(1).collect()
    if not first:
        return []
    chosen = {(r["x"], r["y"], r["z"]): None for r in first}
    with scratch(spark):
        at, fresh = gv.select("v", "x", "y", "z", F.lit(float("inf")).alias("near")), list(chosen)
        for i in range(rounds):
            near = F.least("near", F.array_min(_distances())["d2"])
            at = written(at.crossJoin(one_row(spark, [(j, *c) for j, c in enumerate(fresh)])).select("v", "x", "y", "z", near.alias("near")))
            total = at.agg(F.sum("near")).first()[0]
            if not total:
                break
            drawn = at.where(uniform(i) < F.lit(2.0 * k / total) * F.col("near")).select("x", "y", "z").distinct().collect()  # 2 k of them, about
            fresh = [c for c in sorted((r["x"], r["y"], r["z"]) for r in drawn) if c not in chosen]
            if not fresh:
                break
            chosen.update(dict.fromkeys(fresh))
    points = list(chosen)
    counts = {r["part"]: r["n"] for r in assigned(gv, [(j, *c) for j, c in enumerate(points)]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    at, weight = np.array(points), np.array([counts.get(j, 0) for j in range(len(points))], float)
    draw = np.random.default_rng(seed)
    near, out = np.full(len(points), np.inf), []
    for i in range(min(k, len(points))):
        mass = weight if i == 0 else weight * near
        mass = mass if mass.sum() > 0 else (near > 0).astype(float) if (near > 0).any() else np.ones(len(points))
        # of several draws the one that serves all points best
        best = None
        for j in draw.choice(len(points), size=2 + int(np.log2(k + 1)), p=mass / mass.sum()):
            after = np.minimum(near, ((at - at[j]) ** 2).sum(1))
            cost = float((weight * after).sum())
            if best is None or cost < best[0]:
                best = (cost, int(j), after)
        _, j, near = best
        out.append((i, *map(float, at[j])))
    rest = [p for p in gv.select("x", "y", "z").limit(k - len(out)).collect()] if len(out) < k else []
    return out + [(len(out) + i, r["x"], r["y"], r["z"]) for i, r in enumerate(rest)]


def _spread(centres: Centres) -> list[float]:
    """Half of each centre's distance to the nearest other one; k x k on the driver, in blocks."""
    at = np.array([c[1:] for c in centres])
    out = []
    for a in range(0, len(at), 1024):
        d = ((at[a : a + 1024, None] - at[None]) ** 2).sum(2)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out += (np.sqrt(d.min(1)) / 2).tolist()
    return out


def bounded_step(state: DataFrame, centres: Centres, shifts: list[float]) -> DataFrame:
    """(v, vwgt, x, y, z, part, upper, lower, looked) after centres have moved by `shifts`; centres are numbered from 0, as they lie in the list.

    upper is at least a vertex's distance to its own centre, lower at most that to any other. While upper stays below lower, or below
    half the distance from the own centre to the nearest other one, no distance to others is worked out. looked: distances that were.
    """
    spark = state.sparkSession
    facts = F.broadcast(spark.createDataFrame([([tuple(c) for c in centres], shifts, _spread(centres), max(shifts, default=0.0))], "_cent array<struct<part: int, cx: double, cy: double, cz: double>>, _shift array<double>, _half array<double>, _most double"))
    rows = state.crossJoin(facts).withColumn("_u", F.col("upper") + F.get("_shift", F.col("part"))).withColumn("_l", F.col("lower") - F.col("_most"))
    rows = rows.withColumn("_limit", F.greatest("_l", F.get("_half", F.col("part"))))
    # a margin, so that rounding never decides for the bound; ties are worked out
    loose = F.coalesce(F.col("_u") * (1 + 1e-9) < F.col("_limit"), F.lit(False))
    exact = F.sqrt(_to(F.get("_cent", F.col("part"))))
    rows = rows.withColumn("_e", F.when(~loose, exact))
    tight = F.coalesce(F.col("_e") * (1 + 1e-9) < F.col("_limit"), F.lit(False))
    rows = rows.withColumn("_sorted", F.when(~loose & ~tight, F.slice(F.array_sort(_distances()), 1, 2)))
    new, other = F.get("_sorted", F.lit(0)), F.get("_sorted", F.lit(1))
    looked = F.when(loose, 0).when(tight, 1).otherwise(1 + F.size("_cent"))
    return rows.select(
        "v", "vwgt", "x", "y", "z", F.coalesce(new["part"], F.col("part")).alias("part"), F.coalesce(F.sqrt(new["d2"]), F.col("_e"), F.col("_u")).alias("upper"),
        F.when(F.col("_sorted").isNotNull(), F.coalesce(F.sqrt(other["d2"]), F.lit(float("inf")))).otherwise(F.col("_l")).alias("lower"), looked.cast("long").alias("looked"),
    )


def kmeans(gv: DataFrame, k: int, seed: int = 42, max_iterations: int = 100, tol: float = 1e-4, start: Centres | None = None, bounded: bool | None = None) -> KMeansRun:
    """Lloyd's iterations until no vertex changes its part or no centre moves by tol. The driver reads a row a part for each.

    bounded: keep bounds of distances from one iteration to the next (by default for BOUNDS_FROM centres or more, where that saves more than
    writing them costs); the parts are the same.
    """
    centres = start or (seeds(gv, k, seed) if k <= MOST_SEED_PASSES else oversampled_seeds(gv, k, seed))
    bounded = len(centres) >= BOUNDS_FROM if bounded is None else bounded
    numbered = [(j, *c[1:]) for j, c in enumerate(centres)]
    inertia, converged, i, before, looked = 0.0, False, 0, None, 0
    with scratch(gv.sparkSession) as keep:
        state = gv.select("v", "vwgt", "x", "y", "z", F.lit(0).alias("part"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
        shifts = [0.0] * len(centres)
        for i in range(1, max_iterations + 1):
            if bounded:
                state = written(bounded_step(state, numbered, shifts))
                at = state.crossJoin(one_row(gv.sparkSession, numbered)).withColumn("d2", _to(F.get("_cent", F.col("part"))))
            else:
                at = assigned(gv, numbered).withColumn("looked", F.lit(len(numbered)).cast("long"))
            got = at.groupBy("part").agg(
                *[(F.sum(F.col("vwgt") * F.col(c)) / F.sum("vwgt")).alias(c) for c in "xyz"], F.sum("d2").alias("d2"), F.sum("looked").alias("looked"), F.bit_xor(F.xxhash64("v", "part")).alias("h")
            ).collect()
            inertia, looked = sum(r["d2"] for r in got), looked + sum(r["looked"] for r in got)
            to = {r["part"]: (r["part"], r["x"], r["y"], r["z"]) for r in got if r["x"] is not None}
            after = {r["part"]: r["h"] for r in got}
            new = [to.get(c[0], c) for c in numbered]
            shifts = [sum((a - b) ** 2 for a, b in zip(x[1:], y[1:], strict=True)) ** 0.5 for x, y in zip(new, numbered, strict=True)]
            numbered = new
            if after == before or max(shifts, default=0.0) < tol:
                converged = True
                break
            before = after
        centres = [(c[0], *x[1:]) for c, x in zip(centres, numbered, strict=True)]
        part = keep(written(assigned(gv, centres).select("v", "part")))
    cent = gv.sparkSession.createDataFrame(centres, "part int, cx double, cy double, cz double")
    return KMeansRun(part, cent, inertia, i, converged, looked)


def sources(gv: DataFrame, cent: DataFrame) -> DataFrame:
    """(part, v): the vertex nearest to each centre; ties to the lower vertex. One pass; a task hands on a row a centre."""
    centres = cent.select("part", "cx", "cy", "cz").collect()  # k rows
    at = np.array([[r["cx"], r["cy"], r["cz"]] for r in centres], float).reshape(-1, 3)
    names = pa.array([r["part"] for r in centres], pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = np.full(len(at), np.inf), np.full(len(at), -1, np.int64)
        for whole in batches:
            for start in range(0, len(whole), SOURCE_ROWS):
                batch = whole.slice(start, SOURCE_ROWS)
                v, x = batch.column(0).to_numpy(), np.stack([batch.column(j).to_numpy() for j in (1, 2, 3)], 1)
                order = np.argsort(v, kind="stable")
                d = ((x[order, 0][:, None] - at[:, 0]) ** 2 + (x[order, 1][:, None] - at[:, 1]) ** 2) + (x[order, 2][:, None] - at[:, 2]) ** 2
                best = d.argmin(0)
                low, who = d[best, np.arange(len(at))], v[order][best]
                better = (low < far) | ((low == far) & (who < near))
                far, near = np.where(better, low, far), np.where(better, who, near)
        some = near >= 0
        yield pa.RecordBatch.from_arrays([names.filter(pa.array(some)), pa.array(far[some]), pa.array(near[some])], names=["part", "d", "v"])

    found = gv.select(F.col("v").cast("long").alias("v"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).mapInArrow(run, "part int, d double, v long")
    return found.groupBy("part").agg(F.min(F.struct("d", "v"))["v"].alias("v"))


def gain_table(gv: DataFrame, ge: DataFrame, part: DataFrame, cent: DataFrame) -> DataFrame:
    """(v, src_part, dst_part, topo, geo) of each boundary vertex and part that it touches: topo = ed - id; geo = how much
    nearer, in squared distance, the other part's centre is."""
    return with_geo(gv, moves_of(links(ge, part)), cent)


def with_geo(gv: DataFrame, moves: DataFrame, cent: DataFrame) -> DataFrame:
    """moves (v, src_part, dst_part, topo) with geo."""
    c = F.broadcast(cent.select("part", "cx", "cy", "cz"))
    rows = moves.join(gv.select("v", "x", "y", "z"), "v")
    rows = rows.join(c.toDF("src_part", "cx", "cy", "cz"), "src_part").withColumn("_a", d2("x", "y", "z")).drop("cx", "cy", "cz")
    rows = rows.join(c.toDF("dst_part", "cx", "cy", "cz"), "dst_part").withColumn("_b", d2("x", "y", "z"))
    return rows.select("v", "src_part", "dst_part", "topo", (F.col("_a") - F.col("_b")).alias("geo"))


def calibrated_beta(gains: DataFrame) -> DataFrame:
    """(beta): sqrt of the sum of topo^2 over the sum of geo^2; 1 if there is no row or geo is next to nothing."""
    t, g = F.sum(F.col("topo") * F.col("topo")), F.sum(F.col("geo") * F.col("geo"))
    return gains.agg(t.alias("t"), g.alias("g")).select(F.when(F.col("g") >= 1e-12, F.sqrt(F.col("t") / F.col("g"))).otherwise(1.0).alias("beta"))


def hybrid_gains(gv: DataFrame, ge: DataFrame, part: DataFrame, cent: DataFrame, alpha: float, beta: float | None = None) -> DataFrame:
    """gain_table with gain = alpha * topo + (1 - alpha) * beta * geo; beta is calibrated if it isn't given."""
    gains = gain_table(gv, ge, part, cent)
    factor = gains.crossJoin(F.broadcast(calibrated_beta(gains))) if beta is None else gains.withColumn("beta", F.lit(beta))
    return factor.withColumn("gain", F.lit(alpha) * F.col("topo") + F.lit(1 - alpha) * F.col("beta") * F.col("geo")).drop("beta")


def extent(gv: DataFrame, ge: DataFrame) -> DataFrame:
    """(bbox_d2, max_degree): squared diagonal of the box around all vertices, 1 at least; largest weighted degree, 1 at least."""
    span = [F.max(c) - F.min(c) for c in "xyz"]
    box = gv.agg(F.greatest(F.lit(1.0), span[0] * span[0] + span[1] * span[1] + span[2] * span[2]).alias("bbox_d2"))
    top = ge.groupBy("src").agg(F.sum("w").alias("d")).agg(F.greatest(F.lit(1), F.coalesce(F.max("d"), F.lit(1))).cast("long").alias("max_degree"))
    return box.crossJoin(top)
