"""Elements to graph: faces, dual edges, centroids, CSR rows, subgraphs.

elements(elem_id, verts [, geom_type]), vertices(vert_id, x, y, z), gv(v, vwgt, vsize, x, y, z), ge(src, dst, w) with both
directions of each edge and no self loop, part(v, part).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.geometry import FACES, GMSH_DIMENSION, local_parts

from .prefix import prefix_sums, ranks


def faces(elements: DataFrame, dim: int) -> DataFrame:
    """(elem_id, face): each local face as its sorted vertices. By dimension and number of vertices, not by geometry code.

    Elements with fewer vertices than the dimension's simplex, those of lower dimension, have no face. Any other number of vertices is an
    error. Faces of prisms and pyramids are an extension.
    """
    wrong = F.raise_error(F.concat(F.lit(f"no faces of an element of dimension {dim} with this number of vertices: "), F.size("verts").cast("string")))
    found = F.when(F.size("verts") <= dim, F.array().cast("array<array<bigint>>")).otherwise(wrong.cast("array<array<bigint>>"))
    for (d, n), table in FACES.items():
        if d == dim:
            found = F.when(F.size("verts") == n, local_parts(F.col("verts"), table)).otherwise(found)
    return elements.select("elem_id", F.explode(found).alias("face")).withColumn("face", F.array_sort("face"))


def owned_faces(elements: DataFrame, dim: int) -> DataFrame:
    """(elem_id, face, owner): owner is the least element that has the face."""
    return faces(elements, dim).withColumn("owner", F.min("elem_id").over(W.partitionBy("face")))


def dual_pairs(elements: DataFrame, dim: int) -> DataFrame:
    """(elem_id, owner, n): elements that share n faces with the faces' owner. Of k elements on a face, k - 1 pairs: a star."""
    return owned_faces(elements, dim).where("elem_id <> owner").groupBy("elem_id", "owner").agg(F.count("*").alias("n"))


def dual_edges(elements: DataFrame, dim: int) -> DataFrame:
    """ge of the dual graph: weight 1 for each shared face, parallel edges summed."""
    both = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("n").alias("w")) for a, b in (("elem_id", "owner"), ("owner", "elem_id"))]
    return dual_pairs(elements, dim).select(F.inline(F.array(*both)))  # a union would plan the pairs twice


def face_owners(elements: DataFrame, dim: int) -> DataFrame:
    """(face, owners): how many elements have each face. 1: on the boundary; 3 or more: not a manifold."""
    return faces(elements, dim).groupBy("face").agg(F.count("*").alias("owners"))


def centroids_of_elements(elements: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, x, y, z): the plain mean of an element's vertices."""
    at = elements.select("elem_id", F.explode("verts").alias("vert_id")).join(vertices, "vert_id")
    return at.groupBy(F.col("elem_id").alias("v")).agg(*[(F.sum(c) / F.count("*")).alias(c) for c in "xyz"])


def element_graph(elements: DataFrame, vertices: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """gv and ge of the dual graph: unit weights and sizes, centroids as coordinates."""
    gv = centroids_of_elements(elements, vertices).select("v", F.lit(1).cast("long").alias("vwgt"), F.lit(1).cast("long").alias("vsize"), "x", "y", "z")
    return gv, dual_edges(elements, dim)


def supported(elements: DataFrame) -> DataFrame:
    """elements, unless one has a geometry that no dual graph is made for: then an error."""
    if elements.where(~F.col("geom_type").isin(2, 3, 4, 5, 6)).limit(1).count():
        raise ValueError("unsupported geometry: only triangles, squares, tetrahedra, cubes and prisms have a dual graph")
    return elements


def supported_gmsh(elements: DataFrame) -> DataFrame:
    """elements (gmsh_type), unless one has a type that no dual graph is made for: then an error."""
    if elements.where(~F.col("gmsh_type").isin(2, 3, 4, 5, 6, 7)).limit(1).count():
        raise ValueError("unsupported element type: only triangles, squares, tetrahedra, cubes, prisms and pyramids have a dual graph")
    return elements


def highest_dimension(elements: DataFrame) -> DataFrame:
    """The elements of the highest dimension that the table of Gmsh elements (elem_id, gmsh_type, verts) has."""
    kind = F.create_map(*[F.lit(x) for kv in GMSH_DIMENSION.items() for x in kv])
    ranked = elements.withColumn("_d", kind[F.col("gmsh_type")])
    return ranked.join(F.broadcast(ranked.agg(F.max("_d").alias("_d"))), "_d").drop("_d")


def with_defaults(gv: DataFrame) -> DataFrame:
    """Missing weights and sizes are 1."""
    return gv.withColumn("vwgt", F.coalesce("vwgt", F.lit(1))).withColumn("vsize", F.coalesce("vsize", F.lit(1)))


def totals(gv: DataFrame) -> DataFrame:
    """(tvwgt, invtvwgt): total weight and its inverse, 0 if there is none."""
    total = F.coalesce(F.sum("vwgt"), F.lit(0)).cast("long")
    return gv.agg(total.alias("tvwgt")).withColumn("invtvwgt", F.when(F.col("tvwgt") > 0, 1 / F.col("tvwgt")).otherwise(F.lit(0.0)))


def csr(gv: DataFrame, ge: DataFrame) -> DataFrame:
    """(v, xadj, adjncy, adjwgt): neighbours in order with their weights, and where a vertex's run begins. For export.

    The running total goes over ranges: a window in each, and the ranges' totals.
    """
    rows = ge.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("_n"))
    each = gv.select("v").join(rows, "v", "left").select("v", F.coalesce(F.col("_n.dst"), F.array().cast("array<bigint>")).alias("adjncy"), F.coalesce(F.col("_n.w"), F.array().cast("array<bigint>")).alias("adjwgt"))
    return prefix_sums(each.withColumn("_d", F.size("adjncy").cast("long")), "v", "_d", "xadj").drop("_d").select("v", "xadj", "adjncy", "adjwgt")


def induced(gv: DataFrame, ge: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on the vertices `keep(v)`: weights as they are."""
    ends = keep.select("v").distinct()
    inner = ge.join(ends.withColumnRenamed("v", "src"), "src", "left_semi").join(ends.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return gv.join(ends, "v", "left_semi"), inner.select("src", "dst", "w")


def induced_by_part(gv: DataFrame, ge: DataFrame, part: DataFrame, p: int) -> tuple[DataFrame, DataFrame]:
    """The subgraph of one part, with all edge weights 1."""
    sub_v, sub_e = induced(gv, ge, part.where(F.col("part") == p))
    return sub_v, sub_e.withColumn("w", F.lit(1).cast("long"))


def relabelled(gv: DataFrame, ge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered from 0 in the order of their ids."""
    number = ranks(gv.select("v"), "v", "n")
    out_v = gv.join(number, "v").drop("v").withColumnRenamed("n", "v")
    out_e = ge.join(number.toDF("src", "_s"), "src").join(number.toDF("dst", "_d"), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")
    return out_v, out_e


#: Bytes of dense rows that a task holds at once, or one row if that is longer.
DENSE_BYTES = 4 << 20


def dense_batches(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(v, cells) of rows (v, places of its neighbours) among n vertices, in batches of DENSE_BYTES."""
    width = max(2 * n - 1, 1)
    blank = np.frombuffer(b"0 " * n, np.uint8)[:width]
    step = max(1, DENSE_BYTES // width)
    for batch in batches:
        for low in range(0, len(batch), step):
            rows = batch.slice(low, step)
            size = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
            cells = np.tile(blank, (len(rows), 1))
            cells[np.repeat(np.arange(len(rows)), size), 2 * rows.column(1).flatten().to_numpy(zero_copy_only=False)] = 49
            ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
            texts = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(cells))
            yield pa.RecordBatch.from_arrays([rows.column(0), texts], names=["v", "cells"])


def dense_rows(gv: DataFrame, ge: DataFrame) -> DataFrame:
    """(v, cells): a row of the 0/1 adjacency matrix as text, columns in the order of the ids. Each row is as long as there are vertices, so
    all text grows with their square; a task makes DENSE_BYTES of it at a time."""
    n = gv.count()
    number = ranks(gv.select("v"), "v", "i").select(F.col("v").alias("dst"), "i")
    near = ge.join(number, "dst").groupBy(F.col("src").alias("v")).agg(F.collect_set("i").alias("_n"))
    rows = gv.select(F.col("v").cast("long").alias("v")).join(near, "v", "left").select("v", "_n")
    return rows.mapInArrow(lambda batches: dense_batches(batches, n), "v long, cells string")
