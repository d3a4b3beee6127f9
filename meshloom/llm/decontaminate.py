"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the test items.

Text is lower-cased (A-Z), cut into words and written with one space between them; the automaton scans
that once, and each occurrence maps back through word numbers to character offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, ALNUM_SPACED, LOWER, arrow_rows, text_parts, written

WINDOW = 10
#: Pattern bytes that one broadcast automaton may hold. The windows of a larger benchmark are scanned for in several passes.
BLOCK_PATTERN_BYTES = 8 << 20

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>, char_spans array<array<long>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_SPACED).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """All runs of `size` words; a shorter text, but not an empty one, is one run."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def pattern_blocks(benchmark: DataFrame, size: int, limit: int) -> Iterator[dict[str, tuple[int, list[int]]]]:
    """Windows with their word counts and items, streamed to the driver in blocks of a bounded size."""
    block: dict[str, tuple[int, list[int]]] = {}
    held = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id").toLocalIterator():
        for w in windows(normal_words(row["text"].encode()), size):
            key = w.decode("latin-1")
            if key not in block:
                block[key] = (w.count(b" ") + 1, [])
                held += 2 * len(w)
            block[key][1].append(row["item_id"])
            held += 8
        if held >= limit:
            yield block
            block, held = {}, 0
    yield block


def automaton(block: dict[str, tuple[int, list[int]]]) -> ahocorasick.Automaton:
    """Patterns carry a space at each end, so that they match whole words only."""
    a = ahocorasick.Automaton()
    for key, value in block.items():
        a.add_word(f" {key} ", value)
    if block:
        a.make_automaton()
    return a


def hit_words(a: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Which words are inside an occurrence, and whose windows occur."""
    hit, items = np.zeros(len(words), bool), set()
    if not words or not len(a):
        return hit, items
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    space_at = None
    for end, (count, ids) in a.iter(text):
        if space_at is None:
            space_at = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(space_at, end))  # words before this space
        hit[last - count : last] = True
        items.update(ids)
    return hit, items


def char_spans(text: bytes, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as [first character, end) of the original text."""
    if not hit.any():
        return []
    inside = np.concatenate([[0], ALNUM[np.frombuffer(text.translate(LOWER), np.uint8)].astype(np.int8), [0]])
    starts, stops = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [[int(chars[starts[a]]), int(chars[stops[b - 1]])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _passes(benchmark: DataFrame, size: int, limit: int, documents: DataFrame, one: Callable[[DataFrame, Broadcast, bool, bool], DataFrame]) -> DataFrame:
    """documents after one(documents, patterns, whether it is the first pass, the last) for each block of patterns.

    One block is broadcast at a time: what a pass gives is written before the next block is sent.
    """
    blocks = pattern_blocks(benchmark, size, limit)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        shared = documents.sparkSession.sparkContext.broadcast(block)
        documents = one(documents, shared, first, after is None)
        if after is not None:
            documents = written(documents)
            shared.destroy()
        block, first = after, False
    return documents


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_PATTERN_BYTES) -> DataFrame:
    """A row per document: words, hit words, items found, and the hit spans of the original text.

    Null or empty text has no words and isn't contaminated. Repeated rows and null ids each give their row. A very long text is scanned
    whole. An empty benchmark finds nothing, and empty documents give no rows. Other columns of either table are not read. Items count once
    however often they repeat; a window that several items share counts for each.
    A task holds one automaton, built once, of at most `block_bytes` of patterns and one item; a benchmark beyond that takes several passes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64())), ("char_spans", pa.list_(pa.list_(pa.int64())))])
    between = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])

    def one(rows: DataFrame, patterns: Broadcast, first: bool, last: bool) -> DataFrame:
        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton(patterns.value)
            for batch in batches:
                for a, b, texts in text_parts(batch.column(1)):
                    part = batch.slice(a, b - a)
                    found = [hit_words(auto, normal_words(x)) for x in texts]
                    if not first:
                        for (hit, items), old, more in zip(found, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                            np.logical_or(hit, np.unpackbits(np.frombuffer(old, np.uint8), count=len(hit)).astype(bool), out=hit)
                            items.update(more)
                    if not last:
                        yield arrow_rows({"doc_id": part.column(0), "text": part.column(1), "hit": [np.packbits(h).tobytes() for h, _ in found], "items": [sorted(x) for _, x in found]}, between)
                        continue
                    ordered = [sorted(items, key=str) for _, items in found]
                    n_hit = [int(h.sum()) for h, _ in found]
                    yield arrow_rows({
                        "doc_id": part.column(0),
                        "n_words": [len(h) for h, _ in found],
                        "n_hit": n_hit,
                        "n_items": [len(x) for x in ordered],
                        "items_sha256": [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ordered],
                        "contaminated": [n > 0 for n in n_hit],
                        "item_ids": [sorted(x) for x in ordered],
                        "char_spans": [char_spans(t, h) for t, (h, _) in zip(texts, found, strict=True)],
                    }, schema)

        return rows.mapInArrow(scan, HITS if last else "doc_id long, text string, hit binary, items array<long>")

    return _passes(benchmark, window, block_bytes, documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), one)


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_PATTERN_BYTES) -> DataFrame:
    """The rows of documents, all columns as they are, whose text holds no window of a test item.

    Null and empty texts stay, and so does everything if the benchmark is empty. Repeated rows and null ids are judged by their text alone; very
    long texts are scanned whole. Only the text is handed to Python, and only the decision comes back. Empty input gives no rows.
    """

    def one(rows: DataFrame, patterns: Broadcast, first: bool, last: bool) -> DataFrame:
        @F.arrow_udf("boolean")
        def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            auto = automaton(patterns.value)
            for column in columns:
                yield pa.array([not len(auto) or not any(True for _ in auto.iter((b" " + b" ".join(normal_words(x)) + b" ").decode("latin-1"))) for _, _, texts in text_parts(column) for x in texts], pa.bool_())

        return rows.where(clean(F.col("text").cast("string")))

    return _passes(benchmark, window, block_bytes, documents, one)
