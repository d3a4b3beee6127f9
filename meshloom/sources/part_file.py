"""The binary partition file: number of parts and of vertices as 64-bit, then a 32-bit part a vertex, little-endian.

`spark.read.format("part_file").load(path)` splits a file by bytes, whatever its size; `write_parts` writes it by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from meshloom.operators.prefix import ranks

from .placed import PlacedFile, PlacedWriter, file_system

HEAD = 16
#: Bytes of a split, and of a batch within it.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


@dataclass
class Span(InputPartition):
    """Vertices `first` to `stop`, less one."""

    first: int
    stop: int


class PartReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split = path, max(1, split_bytes // 4)

    def partitions(self) -> list[InputPartition]:
        """Splits by bytes. A file whose length isn't what its head says is an error."""
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as f:
            length = f.size()
            if length < HEAD:
                raise ValueError(f"a partition file has a head of {HEAD} bytes, this one {length} bytes in all")
            _, n = struct.unpack("<QQ", f.read(HEAD))
        if length != HEAD + 4 * n:
            raise ValueError(f"a file of {n} vertices has {HEAD + 4 * n} bytes, this one {length}")
        return [Span(a, min(n, a + self.split)) for a in range(0, n, self.split)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as f:
            for first in range(partition.first, partition.stop, BATCH_BYTES // 4):
                n = min(BATCH_BYTES // 4, partition.stop - first)
                f.seek(HEAD + 4 * first)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(np.frombuffer(f.read(4 * n), "<i4"))], names=["v", "part"])


class PartWriter(PlacedWriter):
    """Rows (at, part): the place of a vertex in its order, from 0; a null `at` is the head, whose two numbers are `part` and `n`."""

    def payload(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bytes]:
        if batch.column(0).null_count:
            rows = batch.to_pylist()
            packed = [struct.pack("<QQ", r["part"], r["n"]) if r["at"] is None else struct.pack("<i", r["part"]) for r in rows]
            places = np.array([0 if r["at"] is None else HEAD + 4 * r["at"] for r in rows], np.int64)
            return places, np.array([len(x) for x in packed], np.int64), b"".join(packed)
        return HEAD + 4 * batch.column(0).to_numpy(), np.full(len(batch), 4, np.int64), batch.column(1).to_numpy().astype("<i4").tobytes()


class PartFile(PlacedFile):
    """Reads (v, part) of a file; writes rows (at, part, n) as PartWriter takes them. Option split_bytes: of a split."""

    writer_class = PartWriter

    @classmethod
    def name(cls) -> str:
        return "part_file"

    def schema(self) -> str:
        return "v long, part int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PartReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def write_parts(part: DataFrame, k: int, path: str, **options: str) -> str:
    """(v, part) in the order of v as one file, written by all tasks at once; returns the path."""
    spark = part.sparkSession
    spark.dataSource.register(PartFile)
    placed = ranks(part.select("v", F.col("part").cast("long").alias("part")), "v", "at")
    head = spark.range(1).select(F.lit(None).cast("long").alias("at"), F.lit(k).cast("long").alias("part"), F.lit(part.count()).cast("long").alias("n"))
    rows = placed.select("at", "part", F.lit(0).cast("long").alias("n")).unionByName(head)
    rows.write.format("part_file").mode("append").options(**options).save(path)
    return path


def read_parts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(v, part) of a file; v counts from 0."""
    spark.dataSource.register(PartFile)
    return spark.read.format("part_file").options(**options).load(path)
