"""Meshes and graphs derived from the star-schema tables, and generated grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.operators.prefix import ranks


#: Line items, and about twice as many pairs of suppliers, that a task of the supplier graph has.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n, the place of each row in the order of a unique key, from 0."""
    return ranks(df, key, "n")


def order_elements(spark: SparkSession, sf_dir: str, n: int, geom_type: int) -> DataFrame:
    """elements: an order with exactly n distinct suppliers, its suppliers as vertices."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("verts"))
    return orders.where(F.size("verts") == n).select(F.col("l_orderkey").alias("elem_id"), F.lit(1).alias("attribute"), F.lit(geom_type).alias("geom_type"), "verts")


def supplier_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertices: suppliers, with made-up coordinates."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("vert_id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"))


def supplier_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the supplier graph is dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))


def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """gv, ge: suppliers that share an order; weights are numbers of orders and of line items.

    Each pair is counted in one direction, by tasks of about ROWS_A_TASK line items: their number grows with the table, not their size.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("s"))
    tasks = supplier_tasks(spark, sf_dir)
    once = item.repartition(tasks, "l_orderkey").distinct()
    a, b = once.toDF("o", "src"), once.toDF("o", "dst")
    pairs = a.join(b, "o").where("src < dst").select("src", "dst").repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    ge = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "w") for x, y in (("src", "dst"), ("dst", "src"))])))
    weight = item.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("vwgt"))
    at = supplier_vertices(spark, sf_dir).withColumnRenamed("vert_id", "v")
    return at.join(weight, "v").select("v", "vwgt", (F.lit(1) + F.col("v") % 2).cast("long").alias("vsize"), "x", "y", "z"), ge


def supplier_part(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """part: a supplier's nation modulo k."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("v"), (F.col("s_nationkey") % k).cast("int").alias("part"))


def embedding_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """gv, part: the first three components of each vector as a point; its label as its part."""
    e = table(spark, sf_dir, "embeddings")
    point = [e["embedding"][i].cast("double").alias(c) for i, c in enumerate("xyz")]
    gv = e.select(F.col("vec_id").alias("v"), (F.lit(1) + F.col("vec_id") % 3).cast("long").alias("vwgt"), F.lit(1).cast("long").alias("vsize"), *point)
    return gv, e.select(F.col("vec_id").alias("v"), F.col("label").cast("int").alias("part"))


def chain(gv: DataFrame) -> DataFrame:
    """ge: each vertex v beside v + 1 and v + 10, with weights 1 + v % 5 and 2."""
    ids = gv.select("v")
    near = ids.select(F.col("v").alias("a"), (F.col("v") + 1).alias("b"), (1 + F.col("v") % 5).cast("long").alias("w"))
    far = ids.select(F.col("v").alias("a"), (F.col("v") + 10).alias("b"), F.lit(2).cast("long").alias("w"))
    pairs = near.unionByName(far).join(ids.toDF("b"), "b", "left_semi")
    return pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "w") for x, y in ("ab", "ba")])))


def event_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """gv, ge, part: a user's events as a path that breaks behind ids that are multiples of 17; part: the user modulo 3."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    step = e.withColumn("b", nxt).where("b is not null").where(F.col("event_id") % 17 != 0).select(F.col("event_id").alias("a"), "b")
    one = F.lit(1).cast("long").alias("w")
    ge = step.select(F.inline(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), one) for x, y in ("ab", "ba")])))
    gv = e.select(F.col("event_id").alias("v"), F.lit(1).cast("long").alias("vwgt"), F.lit(1).cast("long").alias("vsize"), *[F.lit(0.0).alias(c) for c in "xyz"])
    return gv, ge, e.select(F.col("event_id").alias("v"), (F.col("user_id") % 3).cast("int").alias("part"))


# A cube's six tetrahedra about its long diagonal, by corner number (bit 0: x, bit 1: y, bit 2: z).
_KUHN = ((0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7))


def grid(spark: SparkSession, kind: str, n: int, m: int | None = None, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """elements, vertices of a grid of n x m quads or triangles, or n x m x depth cubes or tetrahedra, in arithmetic over a range."""
    m = m or n
    solid = kind in ("hex", "tet")
    depth = (depth or n) if solid else 1
    cell = spark.range(n * m * depth).select("id", (F.col("id") % n).alias("i"), (F.floor(F.col("id") / n) % m).alias("j"), F.floor(F.col("id") / (n * m)).alias("l"))
    corner = lambda di, dj, dl: (F.col("i") + di) + (n + 1) * (F.col("j") + dj) + (n + 1) * (m + 1) * (F.col("l") + dl)
    if kind == "quad":
        shapes, code = [[corner(0, 0, 0), corner(1, 0, 0), corner(1, 1, 0), corner(0, 1, 0)]], 3
    elif kind == "tri":
        shapes, code = [[corner(0, 0, 0), corner(1, 0, 0), corner(1, 1, 0)], [corner(0, 0, 0), corner(1, 1, 0), corner(0, 1, 0)]], 2
    elif kind == "hex":
        shapes, code = [[corner(0, 0, 0), corner(1, 0, 0), corner(1, 1, 0), corner(0, 1, 0), corner(0, 0, 1), corner(1, 0, 1), corner(1, 1, 1), corner(0, 1, 1)]], 5
    elif kind == "tet":
        shapes, code = [[corner(c & 1, c >> 1 & 1, c >> 2) for c in tet] for tet in _KUHN], 4
    else:
        raise ValueError(f"no grid of {kind}")
    each = F.array(*[F.array(*s) for s in shapes])
    elements = cell.select("id", F.posexplode(each).alias("s", "verts")).select((F.col("id") * len(shapes) + F.col("s")).alias("elem_id"), F.lit(1).alias("attribute"), F.lit(code).alias("geom_type"), "verts")
    points = (n + 1) * (m + 1) * (depth + 1 if solid else 1)
    ids = spark.range(points)
    at = ids.select(F.col("id").alias("vert_id"), (F.col("id") % (n + 1)).cast("double").alias("x"), (F.floor(F.col("id") / (n + 1)) % (m + 1)).cast("double").alias("y"), F.floor(F.col("id") / ((n + 1) * (m + 1))).cast("double").alias("z"))
    return elements, at
