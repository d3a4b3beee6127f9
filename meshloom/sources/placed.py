"""One file written by many tasks: each row's bytes go to a place that is known beforehand.

Places come from prefix sums of the rows' lengths, so that no task waits for another and a task that runs again, or twice,
writes the same bytes to the same place. Where a file system allows it, tasks write into the file itself, under another name until
the job commits. Elsewhere (object stores) each task writes a piece, and the commit copies the pieces in order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from meshloom.operators.prefix import prefix_sums

#: Bytes that a task holds before it writes them.
WRITE_BYTES = 4 << 20
COPY_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    """Runs of bytes that a task has written: where each begins, its length, and the file that holds it (the target itself if empty)."""

    runs: list[tuple[int, int, str]]


class PlacedWriter(DataSourceArrowWriter):
    """Rows (at, data): the bytes `data` go to the place `at`. Places may come in any order, but must not overlap."""

    def __init__(self, path: str, in_place: bool, token: str):
        self.path, self.in_place, self.token = path, in_place, token

    def payload(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Place and length of each row's bytes, and all of them joined."""
        data = batch.column(1).cast(pa.large_binary())
        at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        whole = data.buffers()[2]
        return batch.column(0).to_numpy(), np.diff(at), bytes(memoryview(whole)[at[0] : at[-1]]) if whole is not None else b""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = file_system(self.path)
        hidden, runs = f"{path}.{self.token}", []
        piece = "" if self.in_place else f"{hidden}-{uuid.uuid4().hex}"
        out = None
        held, start = bytearray(), -1

        def flush() -> None:
            nonlocal out, held, start
            if not held:
                return
            if out is None:
                out = os.open(hidden, os.O_WRONLY | os.O_CREAT, 0o644) if self.in_place else fs.open_output_stream(piece)
            if self.in_place:
                done = 0
                while done < len(held):
                    done += os.pwrite(out, memoryview(held)[done:], start + done)
            else:
                out.write(bytes(held))
            if runs and runs[-1][0] + runs[-1][1] == start:
                runs[-1] = (runs[-1][0], runs[-1][1] + len(held), piece)
            else:
                runs.append((start, len(held), piece))
            held, start = bytearray(), start + len(held)

        for batch in iterator:
            if not len(batch):
                continue
            places, size, data = self.payload(batch)
            ends = np.cumsum(size)
            cut = [0, *(np.flatnonzero(places[1:] != places[:-1] + size[:-1]) + 1).tolist(), len(size)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if start + len(held) != places[a]:
                    flush()
                    start = int(places[a])
                held += data[ends[a] - size[a] : ends[b - 1]]
                if len(held) >= WRITE_BYTES:
                    flush()
        flush()
        if out is not None:
            os.close(out) if self.in_place else out.close()
        return Wrote(runs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The runs must make up the whole file; then it gets its name."""
        runs = sorted(r for m in messages if m for r in m.runs)
        for (at, size, _), (nxt, _, _) in zip(runs, runs[1:], strict=False):
            if at + size != nxt:
                raise ValueError(f"bytes {at + size} to {nxt} of the file are {'missing' if at + size < nxt else 'written twice'}")
        fs, path = file_system(self.path)
        hidden = f"{path}.{self.token}"
        if self.in_place:
            if not runs:
                os.close(os.open(hidden, os.O_WRONLY | os.O_CREAT, 0o644))
            os.replace(hidden, path)
            return
        used: dict[str, int] = {}
        with fs.open_output_stream(path) as out:
            for _, size, piece in runs:
                with fs.open_input_file(piece) as source:
                    source.seek(used.get(piece, 0))
                    left = size
                    while left:
                        data = source.read(min(COPY_BYTES, left))
                        out.write(data)
                        left -= len(data)
                used[piece] = used.get(piece, 0) + size
        self._remove(runs)

    def _remove(self, runs: list[tuple[int, int, str]]) -> None:
        fs, _ = file_system(self.path)
        for piece in {p for _, _, p in runs if p}:
            fs.delete_file(piece)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = file_system(self.path)
        if self.in_place and os.path.exists(f"{path}.{self.token}"):
            os.remove(f"{path}.{self.token}")
        self._remove([r for m in messages if m for r in m.runs])


class PlacedFile(DataSource):
    """df.write.format("placed_file").mode("append").save(path) of rows (at long, data binary). Option pieces: true to write pieces everywhere."""

    writer_class = PlacedWriter

    @classmethod
    def name(cls) -> str:
        return "placed_file"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        fs, _ = file_system(self.options["path"])
        in_place = isinstance(fs, pafs.LocalFileSystem) and self.options.get("pieces", "false") != "true"
        return self.writer_class(self.options["path"], in_place, uuid.uuid4().hex)


def write_lines(lines: DataFrame, order: list[str], path: str, **options: str) -> str:
    """Text lines (order columns, line) as one file in that order, each with a line feed; returns the path. All tasks write at once."""
    spark = lines.sparkSession
    spark.dataSource.register(PlacedFile)
    rows = lines.select(*order, F.concat("line", F.lit("\n")).cast("binary").alias("data"))
    placed = prefix_sums(rows.withColumn("_bytes", F.octet_length("data").cast("long")), list(order), "_bytes", "at")
    placed.select("at", "data").write.format("placed_file").mode("append").options(**options).save(path)
    return path
