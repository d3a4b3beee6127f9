"""ASCII MSH 4.1 files, from the format's public description. Blocks are found in parallel: no task walks the file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.geometry import GMSH_ARITY
from meshloom.operators.dual import highest_dimension
from meshloom.operators.prefix import ranks
from meshloom.shared import scratch, written

from .lines import numbered_lines
from .mesh_text import Mesh
from .placed import write_lines


@dataclass(frozen=True)
class GmshMesh:
    """elements (elem_id, gmsh_type, verts) of the highest dimension, by tag; vertices (vert_id, x, y, z) by tag; names of groups."""

    elements: DataFrame
    vertices: DataFrame
    names: DataFrame


#: Up to so many block heads are broadcast; beyond, they are joined.
MOST_BROADCAST_HEADS = 1_000_000


def _whole(tokens: str = "tokens") -> Column:
    return F.transform(tokens, lambda t: t.try_cast("long"))


def block_heads(lines: DataFrame, first: int, end: int, lines_of: int) -> DataFrame:
    """(n, size): the block heads of the section whose first head is line `first`, each followed by lines_of * size lines.

    A head's place follows from the one before. So each line that could be a head (four whole numbers, of which the first is a
    dimension; of elements no other line but three can be one, since tags differ) says where the next would be, and these steps
    are doubled: after r rounds a row leaps 2^r blocks, and what the first head reaches is known after log2(blocks) rounds.
    """
    spark = lines.sparkSession
    t = lines.where((F.col("n") >= first) & (F.col("n") < end) & (F.size("tokens") == 4)).select("n", _whole().alias("t"))
    could = t.where(F.forall("t", lambda x: x.isNotNull()) & F.get("t", F.lit(0)).between(0, 3) & (F.get("t", F.lit(3)) >= 0))
    with scratch(spark) as keep:
        heads = written(could.select("n", F.get("t", F.lit(3)).alias("size")))
        leap = heads.select("n", (F.col("n") + 1 + lines_of * F.col("size")).alias("to"))
        found = spark.createDataFrame([(first,)], "n long")
        while True:
            leap = written(leap)
            more = written(found.unionByName(found.join(leap, "n").select(F.col("to").alias("n"))).distinct())
            if more.count() == found.count():
                break
            found = more
            leap = leap.join(leap.toDF("to", "next"), "to").select("n", F.col("next").alias("to"))
        return keep(written(heads.join(found, "n")))


def _in_blocks(lines: DataFrame, heads: DataFrame, first: int, end: int) -> DataFrame:
    """The lines of a section, heads left out, each with the head before it and that one's numbers: (n, tokens, head, of).

    Within a split the last head is a window's; a split that begins inside a block takes the last head before it.
    """
    known = F.broadcast(heads.select("n", F.lit(True).alias("is_head"))) if heads.count() <= MOST_BROADCAST_HEADS else heads.select("n", F.lit(True).alias("is_head"))
    here = lines.where((F.col("n") >= first) & (F.col("n") < end)).join(known, "n", "left")
    head = F.when(F.col("is_head"), F.struct(F.col("n").alias("head"), _whole().alias("of")))
    by_split = W.partitionBy("split").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = here.where("is_head").groupBy("split").agg(F.max_by(head, "n").alias("open"))
    splits = here.select("split").distinct()  # a row a split
    carried = splits.join(last, "split", "left").select("split", F.last("open", ignorenulls=True).over(W.orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("open"))
    rows = here.withColumn("own", F.last(head, ignorenulls=True).over(by_split)).join(F.broadcast(carried), "split")
    return rows.where("is_head is null").select("n", "tokens", F.coalesce("own", "open").alias("in")).select("n", "tokens", "in.*")


def read_msh(spark: SparkSession, path: str) -> GmshMesh:
    """Nodes are joined by their tags, which may have gaps. An element type without a known number of nodes is an error, and so is a line
    that its block doesn't allow. Every split is read by itself; the driver reads section heads alone."""
    lines = numbered_lines(spark, path, comment="")
    total = lines.count()
    marks = lines.where(F.element_at("tokens", 1).startswith("$")).orderBy("n").select("n", F.element_at("tokens", 1).alias("t")).collect()  # two rows a section
    span = {}
    for r, nxt in zip(marks, [*marks[1:], None], strict=True):
        if not r["t"].startswith("$End"):
            span.setdefault(r["t"], (r["n"] + 1, nxt["n"] if nxt else total))
    first, end = span.get("$PhysicalNames", (0, 0))
    names = lines.where((F.col("n") > first) & (F.col("n") < end)).select(
        F.get("tokens", F.lit(1)).try_cast("long").alias("tag"), F.get("tokens", F.lit(0)).try_cast("int").alias("dimension"), F.trim(F.concat_ws(" ", F.slice("tokens", 3, F.greatest(F.size("tokens") - 2, F.lit(0)))), F.lit('"')).alias("name")
    )
    return GmshMesh(highest_dimension(_elements(lines, *span.get("$Elements", (0, 0)))), _nodes(lines, *span.get("$Nodes", (0, 0))), names)


def _nodes(lines: DataFrame, start: int, end: int) -> DataFrame:
    """A block has its tags first, a line each, then its points."""
    if end - start < 2:
        return lines.sparkSession.createDataFrame([], "vert_id long, x double, y double, z double")
    rows = _in_blocks(lines, block_heads(lines, start + 1, end, 2), start + 1, end)
    size = F.get("of", F.lit(3))
    placed = written(rows.select("head", (F.col("n") - F.col("head") - 1).alias("i"), size.alias("size"), "tokens"))
    tag = placed.where("i < size").select("head", "i", F.get("tokens", F.lit(0)).try_cast("long").alias("vert_id"))
    point = placed.where("i >= size").select("head", (F.col("i") - F.col("size")).alias("i"), *[F.get("tokens", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")])
    wrong = F.raise_error(F.concat(F.lit("a node without a tag or a point, in the block of line "), F.col("head").cast("string"))).cast("long")
    both = tag.join(point, ["head", "i"], "full")
    return both.select(F.when(F.col("vert_id").isNull() | F.col("x").isNull(), wrong).otherwise(F.col("vert_id")).alias("vert_id"), *"xyz")


def _elements(lines: DataFrame, start: int, end: int) -> DataFrame:
    if end - start < 2:
        return lines.sparkSession.createDataFrame([], "elem_id long, gmsh_type int, verts array<long>")
    rows = _in_blocks(lines, block_heads(lines, start + 1, end, 1), start + 1, end)
    kind, t = F.get("of", F.lit(2)), _whole()
    arity = F.create_map(*[F.lit(x) for kv in GMSH_ARITY.items() for x in kv])[kind.cast("int")]
    unknown = F.raise_error(F.concat(F.lit("element type "), kind.cast("string"), F.lit(" isn't supported"))).cast("int")
    wrong = F.raise_error(F.concat(F.lit("not an element: "), F.concat_ws(" ", "tokens"))).cast("int")
    fine = F.coalesce(F.forall(t, lambda x: x.isNotNull()) & (F.size("tokens") == 1 + arity), F.lit(False))
    checked = F.when(arity.isNull(), unknown).when(~fine, wrong).otherwise(kind.cast("int"))
    return written(rows.select(F.get(t, F.lit(0)).alias("elem_id"), checked.alias("gmsh_type"), F.slice(t, 2, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("verts")))


#: Nodes of a block that is written.
BLOCK_NODES = 50_000


def write_msh(mesh: Mesh, path: str, **options: str) -> str:
    """The mesh as an ASCII MSH 4.1 file, tags counted from 1, written by all tasks at once; returns the path.

    Nodes lie in blocks of BLOCK_NODES, elements in a block for each type. Codes of types are those of geometries.
    """
    spark = mesh.elements.sparkSession
    kinds = sorted((r["geom_type"], r["count"]) for r in mesh.elements.groupBy("geom_type").count().collect())  # a row a type
    n, count = mesh.vertices.count(), sum(x for _, x in kinds)
    heads = [(0, 0, 0, 0, f"$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n{-(-n // BLOCK_NODES)} {n} 1 {n}"), (2, 0, 0, 0, f"$EndNodes\n$Elements\n{len(kinds)} {count} 1 {count}")]
    heads += [(3, kind, 0, 0, f"{mesh.dimension} 1 {kind} {size}") for kind, size in kinds] + [(4, 0, 0, 0, "$EndElements")]
    form = ["section", "block", "part", "i"]
    lines = spark.createDataFrame(heads, "section int, block long, part int, i long, line string")
    row = lambda section, block, part, i, *words: [F.lit(section).alias("section"), block.cast("long").alias("block"), F.lit(part).alias("part"), i.cast("long").alias("i"), F.concat_ws(" ", *words).alias("line")]
    node = written(ranks(mesh.vertices.select(F.col("vert_id").cast("long").alias("vert_id"), *"xyz"), "vert_id", "k").withColumn("b", F.floor(F.col("k") / BLOCK_NODES)))
    block = spark.range(-(-n // BLOCK_NODES)).select(F.col("id"), F.least(F.lit(BLOCK_NODES), F.lit(n) - F.col("id") * BLOCK_NODES).alias("size"))
    lines = lines.unionByName(block.select(*row(1, F.col("id"), 0, F.lit(0), F.lit(str(mesh.dimension)), F.lit("1 0"), F.col("size").cast("string"))))
    lines = lines.unionByName(node.select(*row(1, F.col("b"), 1, F.col("k"), (F.col("vert_id") + 1).cast("string"))))
    lines = lines.unionByName(node.select(*row(1, F.col("b"), 2, F.col("k"), *[F.col(c).cast("double").cast("string") for c in "xyz"])))
    tags = F.transform("verts", lambda v: (v + 1).cast("string"))
    lines = lines.unionByName(mesh.elements.select(*row(3, F.col("geom_type"), 1, F.col("elem_id"), (F.col("elem_id") + 1).cast("string"), tags)))
    return write_lines(lines, form, path, **options)
