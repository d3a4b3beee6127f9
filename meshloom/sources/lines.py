"""Numbered lines of a text file, whatever splits it is read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.shared import written


def numbered_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(n, tokens, split): the words of each line that has any, comments cut off, numbered from 0 in the order of the file.

    A split is numbered by itself and starts at the number of lines before it; the driver reads a row a split.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    plain = F.trim(F.regexp_replace(F.regexp_replace("value", f"{comment}.*$", "") if comment else F.col("value"), r"\s+", " "))
    rows = text.withColumn("t", plain).where("t <> ''").select("b", F.row_number().over(W.partitionBy("b").orderBy("m")).alias("i"), F.split("t", " ").alias("tokens"))
    at = written(rows)
    start, out = 0, []
    for r in sorted(at.groupBy("b").count().collect(), key=lambda r: r["b"]):
        out.append((r["b"], start))
        start += r["count"]
    offsets = spark.createDataFrame(out, "b long, start long")
    return at.join(F.broadcast(offsets), "b").select((F.col("start") + F.col("i") - 1).alias("n"), "tokens", F.col("b").alias("split"))
