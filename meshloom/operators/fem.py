"""Distributed finite-element bookkeeping: ranks, local and global numbers, assembly, dot products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.geometry import EDGES, local_parts

from .prefix import ranks


def round_robin(elements: DataFrame, ranks: int) -> DataFrame:
    """elements with the rank elem_id modulo ranks."""
    return elements.withColumn("rank", (F.col("elem_id") % ranks).cast("int"))


def rank_vertices(ranked: DataFrame) -> DataFrame:
    """(rank, vert_id): the distinct vertices of each rank's elements."""
    return ranked.select("rank", F.explode("verts").alias("vert_id")).distinct()


def shared_vertices(ranked: DataFrame) -> DataFrame:
    """(vert_id, n_ranks) of the vertices of more than one rank."""
    return rank_vertices(ranked).groupBy("vert_id").agg(F.count("*").alias("n_ranks")).where("n_ranks > 1")


def local_dofs(ranked: DataFrame) -> DataFrame:
    """(rank, vert_id, dof): a rank's vertices numbered from 0 in the order of their ids."""
    return ranks(rank_vertices(ranked), "vert_id", "dof", ["rank"])


def global_offsets(ranked: DataFrame) -> DataFrame:
    """(rank, n, first): how many vertices a rank has, and how many the ranks before it have. A row a rank."""
    n = rank_vertices(ranked).groupBy("rank").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def assembled(ranked: DataFrame) -> DataFrame:
    """(rank, gi, gj, value): the sum of the triangles' 3 x 3 matrices, 2 on the diagonal and -1 off it, of each rank."""
    tri = ranked.where(F.size("verts") == 3)
    pairs = tri.select("rank", F.posexplode("verts").alias("i", "gi"), "verts").select("rank", "i", "gi", F.posexplode("verts").alias("j", "gj"))
    return pairs.groupBy("rank", "gi", "gj").agg(F.sum(F.when(F.col("i") == F.col("j"), 2.0).otherwise(-1.0)).alias("value"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dot) of two vectors (i, value)."""
    return a.toDF("i", "_a").join(b.toDF("i", "_b"), "i").agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0.0)).alias("dot"))


def line_segments(elements: DataFrame, vertices: DataFrame, part: DataFrame) -> DataFrame:
    """(elem_id, part, a, b, x0, y0, z0, x1, y1, z1): the edges of each element, by geometry code, with its part: what a plot draws."""
    found = F.array().cast("array<array<bigint>>")
    for code, table in EDGES.items():
        found = F.when(F.col("geom_type") == code, local_parts(F.col("verts"), table)).otherwise(found)
    edges = elements.select("elem_id", F.explode(found).alias("e")).select("elem_id", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    rows = edges.join(part.toDF("elem_id", "part"), "elem_id")
    for end, n in (("a", 0), ("b", 1)):
        rows = rows.join(vertices.select(F.col("vert_id").alias(end), *[F.col(c).alias(f"{c}{n}") for c in "xyz"]), end)
    return rows.select("elem_id", "part", "a", "b", "x0", "y0", "z0", "x1", "y1", "z1")
