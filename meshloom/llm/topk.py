"""Exact top-k by inner product: a Voronoi kNN join.

Data are grouped by pivots. Summaries of the groups (pivot, size, radius) bound every inner product from
both sides: with x = p + (x - p), q.x lies within |q| * |x - p| of q.p. From the lower bounds, and from the pivots, which are
rows, a query knows a score that some k rows reach, and so which groups can hold a better one. Queries are grouped by pivots too: the
same bounds, from a group's own radius, say which cells of data any of its queries can need, and only those are copied to it. There a matrix
product solves its queries. Scores are integers, so they are exact; bounds are widened by far more than their rounding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidied, written

K = 5
SCALE = 256
#: Pivots are drawn from a sample of so many rows at most; a cell's block has about BLOCK_ROWS rows.
MOST_PIVOTS = 256
BLOCK_ROWS = 4096
#: Queries that one group has, about; and that are multiplied at once.
CHUNK_QUERIES = 16384
STEP = 512


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vec_id: Column, embedding: Column) -> Column:
    """Neither the vector nor a component is null or not finite; an empty vector has no component and counts as none."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vec_id.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & fine


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


@tidied
def top_k(vectors: DataFrame, query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    `query` says which rows are queries; a row isn't a candidate for a query of its own vec_id. Fewer than k candidates: all.
    Vectors that are null, empty, or hold a null or non-finite component take no part; vectors of different lengths
    are never compared. Repeated rows of a vec_id are each a candidate of other queries; a repeated query counts once, by its least
    vector. Very long vectors are taken whole. Empty input gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("_e"), query.alias("_q")).where(usable(F.col("id"), F.col("_e")))
    data = base.select("id", quantised(F.col("_e"), scale).alias("x"), F.coalesce("_q", F.lit(False)).alias("q"))
    out = None
    # a length is a table of its own: vectors of one model have one
    for width in sorted(r[0] for r in data.select(F.size("x")).distinct().collect()):
        part = _top_k(data.where(F.size("x") == width), width, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _reach(low: np.ndarray, size: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each row of lower bounds (a column a cell) the score that `need` rows are sure to reach; -inf if there are too few."""
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(size[order], axis=1) >= need[:, None]
    at = np.take_along_axis(low, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0]
    return np.where(enough.any(1), at, -np.inf)


def _bounds(centre: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slack = 1e-6 * (1 + np.abs(centre) + spread)
    return centre - spread - slack, centre + spread + slack


def _by_place(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest one that is left."""
    left, at, out = list(range(1, len(pivots))), 0, [0]
    while left:
        at = left.pop(int(((pivots[left] - pivots[at]) ** 2).sum(1).argmin()))
        out.append(at)
    return out


def query_groups(pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, n: np.ndarray, reach: np.ndarray, own: np.ndarray, k: int, most: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """The groups of each cell's queries (the first one, and how many), and the groups that each cell's data are copied to.

    n, reach, own: number of a cell's queries, their radius, and the most rows that one of them has under its id. A group has about
    `most` queries of neighbouring cells; a cell of more is several groups.
    """
    of: dict[int, tuple[int, int]] = {}
    members: list[list[int]] = []
    held = most
    for c in _by_place(pivots):
        if not n[c]:
            continue
        parts = max(1, -(-int(n[c]) // most))
        if parts == 1 and held + n[c] <= most:
            members[-1].append(c)
            of[c] = (len(members) - 1, 1)
            held += int(n[c])
        else:
            of[c] = (len(members), parts)
            members += [[c] for _ in range(parts)]
            held = int(n[c]) if parts == 1 else most
    norm = np.sqrt((pivots * pivots).sum(1))
    low, high = _bounds(pivots @ pivots.T, norm[:, None] * radius + reach[:, None] * norm + reach[:, None] * radius)
    needed = (high >= _reach(low, size, own + k)[:, None]) & (size > 0)
    groups: list[list[int]] = [[] for _ in pivots]
    for g, cells in enumerate(members):
        for c in np.flatnonzero(needed[cells].any(0)):
            groups[c].append(g)
    return of, groups


def _top_k(data: DataFrame, width: int, k: int) -> DataFrame:
    spark = data.sparkSession
    n = data.count()
    pivots = _pivots(data, width, n)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        norm = (p * p).sum(1)
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            d2 = (x * x).sum(1)[:, None] - 2 * x @ p.T + norm
            cell = d2.argmin(1)
            dist = np.sqrt(np.maximum(((x - p[cell]) ** 2).sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "x", "q", "cell", "dist"])

    cells = written(data.mapInArrow(assign, "id long, x array<long>, q boolean, cell int, dist double"))
    # a query is an id: its least vector, and how many rows have the id, none of which is a candidate
    vector = F.when(F.col("q"), F.struct("x", "cell", "dist"))
    queries = written(cells.groupBy("id").agg(F.min(vector).alias("v"), F.count("*").alias("own")).where("v is not null").select("id", "v.*", "own"))
    # as many rows as there are pivots, at most MOST_PIVOTS
    size, radius, asked, reach, own = (np.zeros(len(pivots), t) for t in (np.int64, np.float64, np.int64, np.float64, np.int64))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("own").alias("own")).collect():
        asked[r["cell"]], reach[r["cell"]], own[r["cell"]] = r["n"], r["radius"], r["own"]
    of, groups = query_groups(pivots, size, radius, asked, reach, own, k, CHUNK_QUERIES)
    blocks = np.maximum(1, -(-size // BLOCK_ROWS))
    facts = spark.sparkContext.broadcast((pivots, size, radius, blocks, groups))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to each block of the cells that its bounds leave, of those that its group has."""
        p, size, radius, blocks, groups = facts.value
        has = np.zeros((max((g for x in groups for g in x), default=-1) + 1, len(p)), bool)
        for c, x in enumerate(groups):
            has[x, c] = True
        for batch in batches:
            x, group = _matrix(batch.column(1), width).astype(np.float64), batch.column(2).to_numpy()
            need = batch.column(3).to_numpy() + k
            centre = x @ p.T
            low, high = _bounds(centre, np.sqrt((x * x).sum(1))[:, None] * radius)
            least = _reach(low, size, need)
            # pivots are rows
            falling = -np.sort(-np.where(size > 0, low + np.sqrt((x * x).sum(1))[:, None] * radius, -np.inf), axis=1)
            some = need <= falling.shape[1]
            least[some] = np.maximum(least[some], np.take_along_axis(falling[some], need[some][:, None] - 1, 1)[:, 0])
            rows, to = np.nonzero((high >= least[:, None]) & has[group])
            times = blocks[to]
            rows, to = np.repeat(rows, times), np.repeat(to, times)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(to.astype(np.int32)), pa.array(block.astype(np.int32)), picked.column(2), pa.array(np.ones(len(rows), bool))], names=["id", "x", "cell", "block", "group", "q"])

    def solve(group: pa.Table) -> pa.Table:
        """A group's queries against a block's rows."""
        is_query = group["q"].to_numpy()
        ids, x = group["id"].to_numpy(), _matrix(group["x"].combine_chunks(), width)
        q_ids, q = ids[is_query], x[is_query]
        ids, x = ids[~is_query], x[~is_query]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        found = [(np.zeros(0, np.int64),) * 3]
        # doubles hold whole numbers exactly below 2 ** 53
        exact = width * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 1 << 52
        xt = x.T.astype(np.float64) if exact else x.T
        for at in range(0, len(q_ids), STEP):
            scores = q[at : at + STEP].astype(xt.dtype) @ xt
            for one, s in zip(q_ids[at : at + STEP], scores.astype(np.int64), strict=True):
                low, high = np.searchsorted(ids, [one, one + 1])
                of = ids
                if low < high:  # the query's own rows
                    s, of = np.delete(s, slice(low, high)), np.delete(ids, slice(low, high))
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above = np.flatnonzero(s > least)
                    # rows are in the order of vec_id: of the ties the first ones
                    pick = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
                    s, of = s[pick], of[pick]
                found.append((np.full(len(s), one), of, s))
        return pa.table([np.concatenate([f[j] for f in found]) for j in range(3)], names=["query_id", "vec_id", "score"])

    by_cell = lambda values: F.element_at(F.array(*values), F.col("cell") + 1)
    block_of = F.pmod(F.xxhash64("id", "dist"), by_cell([F.lit(int(x)) for x in blocks])).cast("int")
    first, parts = (by_cell([F.lit(of.get(c, (0, 1))[j]) for c in range(len(pivots))]) for j in (0, 1))
    asking = queries.select("id", "x", (first + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("group"), "own")
    # a row a cell
    to = spark.createDataFrame([(c, x) for c, x in enumerate(groups) if x], "cell int, groups array<int>")
    dealt = cells.join(F.broadcast(to), "cell").select("id", "x", "cell", block_of.alias("block"), F.explode("groups").alias("group"), F.lit(False).alias("q"))
    sent = asking.mapInArrow(send, "id long, x array<long>, cell int, block int, group int, q boolean")
    near = dealt.unionByName(sent).groupBy("cell", "block", "group").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pivots(data: DataFrame, width: int, n: int) -> np.ndarray:
    """About sqrt(n) rows, MOST_PIVOTS at most, chosen by a hash of the id; equal rows are one pivot."""
    want = int(min(MOST_PIVOTS, max(1, round(n**0.5 / 4))))
    rate = int(min(1.0, 4 * want / max(1, n)) * 1_000_000) + 1
    rows = data.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate).select(F.xxhash64("id").alias("_o"), "x").orderBy("_o", "id").limit(want).collect()
    if not rows:
        rows = data.orderBy("id").limit(1).collect()
    return np.unique(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), width), axis=0)
