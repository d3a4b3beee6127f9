"""Helpers that the text operators share: shared-folder tables, Arrow batches, vectorised words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.shared import tidied, written  # noqa: F401  used by the operators

#: Text bytes that one vectorised step takes; a longer text is one step of its own.
BLOCK_BYTES = 1 << 20


#: Bytes of rows that Spark hands to Python at once. By default it is 64 MB, of which a task holds several copies.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark only. Batches for Python are bounded by bytes, unless the session bounds them."""
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, which may have dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def doc_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(m)).cast("int")


def raw_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_parts(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about `limit` bytes with their texts as bytes; no more than one range is copied at a time."""
    size = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy() + 1
    place = (np.cumsum(size) - size) // limit
    cut = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(size)] if len(size) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield a, b, raw_texts(column.slice(a, b - a))
    released()


def released() -> None:
    """Gives Arrow's unused memory back to the system; a worker would hold it while other tasks of its executor run."""
    pa.default_memory_pool().release_unused()


def arrow_rows(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


# --- words and hashes over UTF-8 bytes -------------------------------------------------------------

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Word bytes: digits, a-z after lower-casing, and every byte of a character beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
ALNUM_SPACED = bytes(LOWER[b] if ALNUM[LOWER[b]] else 32 for b in range(256))
#: Token bytes: all but space and \t..\r.
NON_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Packed:
    """Texts of one block, translated and joined by a separator byte, with word spans and word hashes."""

    def __init__(self, texts: list[bytes], translation: bytes = LOWER, word_bytes: np.ndarray = ALNUM):
        self.raw = (b" ".join(texts) + b" ").translate(translation)
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = word_bytes[self.data]
        edge = np.diff(inside)
        self.word_start = np.flatnonzero(edge == 1)
        self.word_stop = np.flatnonzero(edge == -1)
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.concatenate([np.searchsorted(self.word_start, self.start), [len(self.word_start)]])

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start)), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal on every machine and run."""
        n = len(self.data)
        power, inverse = _powers(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_RANDOM[self.data] * power[:n], out=prefix[1:])
        h = (prefix[self.word_stop] - prefix[self.word_start]) * inverse[self.word_start]
        return mixed(h ^ (self.word_stop - self.word_start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document index and hash of each run of k words; a text of fewer words, but not none, has one run."""
        words = self.word_hashes()
        counts = np.diff(self.first)
        runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        docs = np.repeat(np.arange(len(counts)), runs)
        at = np.arange(len(docs)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(self.first[:-1], runs)
        last = np.repeat(self.first[1:], runs)
        h = np.zeros(len(docs), np.uint64)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(at + j < last, padded[at + j], np.uint64(1))
        return docs, mixed(h)
