"""Whitening of embeddings: one aggregation of the covariance's upper triangle, LAPACK on the driver, a projection of each row.

Spark SQL sums a centred product for every pair of dimensions, i <= j, so that each task sends one row, whatever its number of
vectors. The covariance is dimensions x dimensions, bounded by the vectors' length, and is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidied, written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Pairs of dimensions that one aggregation sums: all of vectors of 90 entries or fewer. A longer vector's triangle is summed in
#: several passes over the written vectors, since Spark plans each pair.
MOST_PAIRS = 4096
#: Entries beyond this aren't exact as whole numbers after scaling.
MOST_ENTRY = float(1 << 46)
#: Eigenvalues below this part of the largest one are rounding, not variance.
RANK_TOLERANCE = 1e-12
#: Vectors that a task projects at once.
STEP_ROWS = 4096


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>), written: floor(64 * c) + 1000000 of each entry c as double; rows that take no part are left out."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.size("c") > 0, F.lit(False)) & F.coalesce(F.forall("c", lambda v: F.coalesce(F.abs(v) <= MOST_ENTRY, F.lit(False))), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(fine)
    rows = written(rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x")))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def column_sums(rows: DataFrame, column: str, d: int) -> tuple[int, list]:
    """How many rows there are and the sum of each entry of an array column, in one aggregation."""
    n, sums = rows.selectExpr("count(*)", "array(" + ", ".join(f"sum({column}[{i}])" for i in range(d)) + ")").collect()[0]
    return n, sums


def triangle_sums(pairs: list[tuple[int, int]]) -> str:
    """An SQL expression: for each pair of dimensions the sum of the products of their centred entries, columns c0, c1, ..."""
    return "array(" + ", ".join(f"sum(c{i} * c{j})" for i, j in pairs) + ")"


def covariance(rows: DataFrame, column: str, n: int, means: list[float]) -> np.ndarray:
    """The covariance of an array column, divisor n, entries centred before they are multiplied."""
    d = len(means)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    # no entry is null here; that Spark knows it makes each sum cheaper
    centred = rows.selectExpr(*[f"coalesce(cast({column}[{i}] as double) - {float(m)!r}D, 0D) as c{i}" for i, m in enumerate(means)])
    out = np.zeros((d, d))
    for start in range(0, len(upper), MOST_PAIRS):
        pairs = upper[start : start + MOST_PAIRS]
        (sums,) = centred.selectExpr(triangle_sums(pairs)).collect()[0]
        for (i, j), s in zip(pairs, sums, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def components_of(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of the largest `most`; those of no variance are left out."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK_TOLERANCE * max(values.max(), 0.0)]
    return values[order], vectors[:, order]


_WHITE = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])


def projected(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): the exact sum of (n * x - S)^2, null where it is beyond 64 bits, and the row on each component over its root."""
    total, mean = np.array(sums, np.int64), np.array([s / n for s in sums])
    onto, k = vectors / np.sqrt(values), len(values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), STEP_ROWS):
                batch = whole.slice(start, STEP_ROWS)
                x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
                off = n * x.astype(float) - total
                deviation = ((n * x - total) ** 2).sum(1)
                beyond = (off**2).sum(1) >= 2.0**63
                w = (x - mean) @ onto
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(batch) + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield arrow_rows({"vec_id": batch.column(0), "deviation": pa.array(deviation, mask=beyond), "w": lists}, _WHITE)

    return rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")


@tidied
def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector that takes part and each component.

    Null vectors, and vectors that are empty or hold a null, a value that isn't finite or one beyond 2^46, are left out; so are vectors of
    another length than most have. Components without variance, of which there are some if vectors are fewer than dimensions, have no row;
    so one vector, or copies of one, give none. Repeated rows each count and each have their rows; null ids are kept. Of equal
    eigenvalues any basis is taken, the same for all rows. Empty input gives no rows. Other columns aren't read.
    """
    rows = whole_vectors(embeddings)
    first = rows.select(F.size("x")).first()
    values, n, white, worst, trace = np.zeros(0), 0, None, 0.0, 0.0
    if first:
        n, sums = column_sums(rows, "x", first[0])
        v = covariance(rows, "x", n, [s / n for s in sums])
        values, vectors = components_of(v, components)
        trace = float(np.trace(v))
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = written(projected(rows, n, sums, values, vectors))
    _, got = column_sums(white, "w", len(values))
    worst = float(np.abs(covariance(white, "w", n, [s / n for s in got]) - np.eye(len(values))).max())
    share = F.array(*[F.lit(float(e) / trace) for e in values])
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(worst).alias("identity_error"))
