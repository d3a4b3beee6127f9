"""The mesh text format, version 1.0: dimension, elements, boundary, vertices, and nodes of high-order meshes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.geometry import arity
from meshloom.operators.prefix import prefix_sums

from .lines import numbered_lines
from .placed import write_lines

_SECTIONS = ("dimension", "elements", "boundary", "vertices", "nodes")


@dataclass(frozen=True)
class Mesh:
    """elements and boundary (elem_id, attribute, geom_type, verts); vertices (vert_id, x, y, z)."""

    dimension: int
    elements: DataFrame
    boundary: DataFrame
    vertices: DataFrame


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """A mesh file in which each element and vertex is a line of its own; values of nodes may lie on lines as they will.

    Section words stand at a line's start; other lines outside sections are skipped. An unknown geometry, a line of the wrong
    length or a wrong count of lines is an error. Coordinates that a vertex lacks are 0. Of high-order nodes
    the first are the vertices. Lines are read in parallel; the driver reads section heads alone.
    """
    lines = numbered_lines(spark, path)
    head = F.element_at("tokens", 1)
    found = lines.where(head.isin(*_SECTIONS)).orderBy("n").collect()  # a row a section
    total = lines.count()
    starts = {r["tokens"][0]: (r["n"], r["tokens"]) for r in reversed(found)}
    ends = {r["tokens"][0]: (found[i + 1]["n"] if i + 1 < len(found) else total) for i, r in reversed(list(enumerate(found)))}

    def first(name: str, skip: int) -> tuple[int | None, int]:
        """The number that follows a section's word, on its line or the next, and the first line after it."""
        if name not in starts:
            return None, 0
        n, tokens = starts[name]
        if len(tokens) > 1:
            return int(tokens[1]), n + 1
        row = lines.where(F.col("n") == n + 1).first()
        return (int(row["tokens"][0]), n + 2) if row and n + 1 < ends[name] else (None, n + 1 + skip)

    def elements(name: str) -> DataFrame:
        count, start = first(name, 0)
        count = count or 0
        if start + count > ends.get(name, start + count):
            raise ValueError(f"{name}: fewer lines than {count}")
        num = F.transform("tokens", lambda t: t.try_cast("long"))
        # one condition, since the optimizer would test the shape of lines outside the section first
        here = (F.col("n") >= start) & (F.col("n") < start + count)
        rows = lines.select("n", (F.col("n") - start).alias("elem_id"), num.alias("t"))
        code = F.get("t", F.lit(1))
        fine = F.coalesce(F.forall("t", lambda x: x.isNotNull()) & (F.size("t") == 2 + arity(code)) & (arity(code) > 0), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit(f"{name}: not an element: "), F.array_join("t", " ", "?"))).cast("boolean")
        checked = rows.where(F.when(here, F.when(fine, True).otherwise(wrong)).otherwise(False))
        return checked.select("elem_id", F.get("t", F.lit(0)).cast("int").alias("attribute"), code.cast("int").alias("geom_type"), F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))).alias("verts"))

    dimension, _ = first("dimension", 0)
    if dimension is None:
        raise ValueError("a mesh file has a dimension")
    count, start = first("vertices", 0)
    count = count or 0
    row = lines.where(F.col("n") == start).first() if count else None
    inline = bool(row) and start < ends["vertices"] and row["tokens"][0].lstrip("+-").isdigit()
    if inline:
        dims = int(row["tokens"][0])
        begin = start + 1
        if begin + count > ends["vertices"]:
            raise ValueError(f"vertices: fewer lines than {count}")
        point = lines.where((F.col("n") >= begin) & (F.col("n") < begin + count))
        at = [F.try_element_at("tokens", F.lit(i + 1)).try_cast("double") if i < dims else F.lit(0.0) for i in range(3)]
        vertices = point.select((F.col("n") - begin).alias("vert_id"), *[c.alias(x) for c, x in zip(at, "xyz", strict=True)])
    else:
        vertices = _nodes(spark, lines, starts, ends, count)
    return Mesh(dimension, elements("elements"), elements("boundary"), vertices)


def _nodes(spark: SparkSession, lines: DataFrame, starts: dict, ends: dict, count: int) -> DataFrame:
    """The first `count` nodes of a high-order mesh. Ordering 0: all x, then all y, ...; 1: point by point."""
    if "nodes" not in starts:
        return spark.createDataFrame([], "vert_id long, x double, y double, z double")
    begin, end = starts["nodes"][0] + 1, ends["nodes"]
    some = {r["tokens"][0].rstrip(":").lower(): r for r in lines.where((F.col("n") >= begin) & (F.col("n") < begin + 8)).collect()}
    dims, ordering = int(some["vdim"]["tokens"][1]), int(some["ordering"]["tokens"][1])
    body = lines.where((F.col("n") > some["ordering"]["n"]) & (F.col("n") < end)).withColumn("k", F.size("tokens").cast("long"))
    placed = prefix_sums(body, "n", "k", "before").select("before", F.posexplode("tokens").alias("p", "t"))
    values = placed.select((F.col("before") + F.col("p")).alias("i"), F.col("t").try_cast("double").alias("value"))
    dofs = int(body.agg(F.sum("k")).first()[0] or 0) // dims
    node, axis = (F.col("i") % dofs, F.floor(F.col("i") / dofs)) if ordering == 0 else (F.floor(F.col("i") / dims), F.col("i") % dims)
    rows = values.select(node.alias("vert_id"), axis.alias("d"), "value").where(F.col("vert_id") < count)
    return rows.groupBy("vert_id").agg(*[F.coalesce(F.max(F.when(F.col("d") == d, F.col("value"))), F.lit(0.0)).alias(x) for d, x in enumerate("xyz")])


def write_mesh(mesh: Mesh, path: str, **options: str) -> str:
    """The mesh as one text file, written by all tasks at once; for tools that read such files. Returns the path."""
    spark = mesh.elements.sparkSession
    heads = [(0, 0, f"mesh v1.0\n\ndimension\n{mesh.dimension}"), (1, -1, f"\nelements\n{mesh.elements.count()}"), (2, -1, f"\nboundary\n{mesh.boundary.count()}"), (3, -1, f"\nvertices\n{mesh.vertices.count()}\n3")]
    lines = spark.createDataFrame(heads, "section int, i long, line string")
    for section, table in ((1, mesh.elements), (2, mesh.boundary)):
        words = F.concat_ws(" ", "attribute", "geom_type", F.col("verts").cast("array<string>"))
        lines = lines.unionByName(table.select(F.lit(section).alias("section"), F.col("elem_id").cast("long").alias("i"), words.alias("line")))
    at = F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in "xyz"])
    lines = lines.unionByName(mesh.vertices.select(F.lit(3).alias("section"), F.col("vert_id").cast("long").alias("i"), at.alias("line")))
    return write_lines(lines, ["section", "i"], path, **options)
