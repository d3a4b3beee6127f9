"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts, held as sorted arrays by order, predicts each byte from the longest context that the training texts
have. A byte not seen there costs an escape (method C) and is predicted by the next shorter context, from whose
counts the symbols of the longer one are excluded; at the end all symbols not yet excluded are equally likely.
Beside it stands a base: add-one unigrams of whole words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, Packed, doc_remainder, mixed, text_parts, tidied, written

#: Bytes of context. A key is a context and the byte after it, so 7 bytes of 64 bits.
ORDER = 6
#: UTF-8 has neither byte: START fills the context before a text, END closes it.
START, END = 0xFE, 0xFF
SYMBOLS = 256
#: Keys of the highest order whose values every task holds, at most: the most frequent. A cache only. 12 bytes each.
MOST_ENTRIES = 1_000_000
#: Words whose counts every task holds, at most: the most frequent. 16 bytes each.
MOST_COMMON = 400_000
_U = np.uint64
#: Kinds of counts and of rows of a block; counts of orders 0 and 1 have their order as kind.
_TOKEN, _DOCS = -1, -2
#: A token's end counts as a token; no word has this hash but by chance.
END_TOKEN = mixed(np.array([0xE0D], np.uint64))[0]


def context_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte and of each text's end, and where each text's keys begin (one more than texts)."""
    pad = bytes([START]) * order
    raw = b"".join(pad + t + b"\xff" for t in texts) + bytes(8)
    data = np.frombuffer(raw, np.uint8)
    eight = np.ndarray((len(raw) - 8,), ">u8", buffer=raw, strides=(1,)).astype(np.uint64)
    keys = eight >> _U(8 * (7 - order))
    real = data[order : len(data) - 8 + order] != START
    if order:
        real[-order:] = False
    real = real[: len(keys)]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return keys[real], np.concatenate([[0], np.cumsum(lengths)])


def _mask(n: int) -> np.uint64:
    return _U((1 << (8 * n)) - 1)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Trie:
    """counts[k]: (keys of k + 1 bytes, counts) of order k, sorted by key; a context's entries are neighbours.

    Entries may have been left out. What they count stays in their context, as a part of its escape.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(counts) - 1
        self.entries = counts
        self.contexts = []
        for k, (keys, n) in enumerate(counts):
            context, first = np.unique(keys >> _U(8), return_index=True)
            total = kept = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            distinct = np.diff(np.concatenate([first, [len(keys)]]))
            excluded = np.zeros(len(context), np.int64)
            if k and len(first):
                # how often the context itself occurs; START contexts aren't entries of the next shorter order
                at, there = _find(counts[k - 1][0], context)
                total = np.maximum(kept, np.where(there, counts[k - 1][1][at], 0))
                # what the next shorter context counts for the symbols of this one
                at, there = _find(counts[k - 1][0], keys & _mask(k))
                excluded = np.add.reduceat(np.where(there, counts[k - 1][1][at], 0), first)
            self.contexts.append((context, total, total - kept, distinct, excluded))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after its context."""
        out = np.zeros(len(keys))
        at = np.arange(len(keys))  # not yet predicted
        gone = np.zeros(len(keys), np.int64)  # counts and number of the excluded symbols
        gone_symbols = np.zeros(len(keys), np.int64)
        for k in range(self.order, -1, -1):
            context, total, left_out, distinct, excluded = self.contexts[k]
            if not len(context):
                continue
            some = keys[at]
            c, known = _find(context, (some >> _U(8)) & _mask(k))
            e, seen = _find(self.entries[k][0], some & _mask(k + 1))
            fresh = distinct[c] - gone_symbols[at]
            escape = left_out[c] + fresh
            whole = np.maximum(total[c] - gone[at] + fresh, 1)
            out[at] += np.where(known, np.log10(np.where(seen, self.entries[k][1][e], np.where(escape > 0, escape, whole)) / whole), 0.0)
            gone[at] = np.where(known, excluded[c], 0)
            gone_symbols[at] = np.where(known, distinct[c], gone_symbols[at])
            at = at[~(known & seen)]
        out[at] -= np.log10(np.maximum(SYMBOLS - gone_symbols[at], 1))
        return out


class Table:
    """Key to value by open addressing, a few numpy steps for a whole array of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 1.5).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.empty = _U((1 << 64) - 1)
        self.keys = np.full(1 << bits, self.empty)
        self.values = np.zeros(1 << bits, values.dtype)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == self.empty]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free[first]]] = keys[free[first]]
            self.values[slot[free[first]]] = values[free[first]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys have one."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out, found = self.values[slot], there == keys
        todo = np.flatnonzero(~found & (there != self.empty))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            hit = todo[there == keys[todo]]
            found[hit], out[hit] = True, self.values[slot[hit]]
            todo = todo[(there != keys[todo]) & (there != self.empty)]
        return out, found


# --- training -------------------------------------------------------------------------------------

#: Text bytes that a training step merges before it sends counts; text bytes of a block of scored documents.
MERGE_BYTES = 8 << 20
BLOCK_TEXT = 4 << 20
#: Bytes of text beyond the cache that end a block of scored documents.
BLOCK_KEYS = 500_000


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[: len(k)]
    return k[first], np.add.reduceat(n, first) if len(first) else n


class Counts:
    """Running counts of keys, merged whenever what is new outgrows what is merged."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > 500_000 and self.waiting > len(self.keys[0]):
            self.take(keep=True)

    def take(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        k, n = _summed(self.keys, self.counts)
        self.keys, self.counts, self.waiting = ([k], [n], 0) if keep else ([], [], 0)
        return k, n


def _suffix_first(keys: np.ndarray) -> np.ndarray:
    """The last three bytes of a 7-byte key in front, so that keys of one suffix are neighbours; _suffix_last undoes it.

    The first two of them are the last two of the context.
    """
    return ((keys & _mask(3)) << _U(32)) | (keys >> _U(24))


def _suffix_last(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(32)) | ((keys & _mask(4)) << _U(24))


def _dealt(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Places of the keys in the order of their buckets, the buckets that have some, and where each one's places end.

    A context's key (suffix first) is dealt by the last two bytes of the context, so a bucket has all entries of its contexts of two
    bytes or more; a word by its hash.
    """
    bucket = (mixed(keys >> _U(40) if kind == ORDER else keys) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, size = np.unique(bucket, return_counts=True)
    return order, some.tolist(), np.cumsum(size)


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of one weight together, since most high ones are 0, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def _opened(data: bytes, kind: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> bytes:
    """Keys as differences; small ones where they are sorted."""
    return _squeezed(np.diff(keys, prepend=_U(0)))


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(_opened(data), dtype=np.uint64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch; schema is Spark's."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], types[t]) for j, (_, t) in enumerate(fields)], names=[name for name, _ in fields])


SENT = "bucket int, kind int, keys binary, counts binary"
#: Keys of one kind and bucket whose counts have `level` + 1 binary digits; total is the sum of their counts.
COUNTED = "kind int, bucket int, level int, n_keys long, total long, keys binary, counts binary"


def _buckets(spark: SparkSession) -> int:
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def count_all(documents: DataFrame, held_mod: int, held_rest: int) -> DataFrame:
    """COUNTED over all training documents, written: words by hash (kind _TOKEN), keys of order ORDER (suffix first) and of
    orders 0 and 1. Those two orders come in parts from several tasks, with the task's first bucket.

    Each task sends its distinct keys once, packed by bucket; a bucket's task merges them as they come, and holds its
    distinct keys only. The orders between follow from the highest one inside a bucket.
    """
    buckets = _buckets(documents.sparkSession)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts, held = Counts(), Counts(), 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, (keys, n) in ((_TOKEN, words.take()), (ORDER, contexts.take())):
                order, some, ends = _dealt(kind, keys, buckets)
                rows += [(b, kind, _steps(keys[mine]), _squeezed(n[mine])) for b, mine in zip(some, np.split(order, ends), strict=False)]
            return _batch(rows, SENT)

        for batch in batches:
            for a, b, raw in text_parts(batch.column(0)):
                texts = [t.translate(LOWER) for t in raw]
                p = Packed(texts, LOWER, NON_SPACE)
                for counts, keys in ((words, p.word_hashes()), (words, np.full(b - a, END_TOKEN)), (contexts, _suffix_first(context_keys(texts)[0]))):
                    counts.add(*np.unique(keys, return_counts=True))
                held += len(p.data)
                if held >= MERGE_BYTES:
                    held = 0
                    yield flush()
        if held:
            yield flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts = Counts(), Counts()
        for batch in batches:
            for kind, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (contexts if kind == ORDER else words).add(_unstepped(k), _opened(n, "<i8"))
        deep = contexts.take()
        for kind, (keys, n) in ((_TOKEN, words.take()), (ORDER, deep)):
            order, some, ends = _dealt(kind, keys, buckets)
            for b, mine in zip(some, np.split(order, ends), strict=False):
                yield _batch(_levels(kind, b, keys[mine], n[mine]), COUNTED)
        keys, n = _suffix_last(deep[0]), deep[1]
        for k in (1, 0):
            keys, n = _summed([keys & _mask(k + 1)], [n])
            if len(keys):
                yield _batch(_levels(k, 0, keys, n), COUNTED)

    train = documents.where(F.col("doc_id").isNull() | (doc_remainder(F.col("doc_id"), held_mod) != held_rest)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed = train.mapInArrow(send, SENT).repartition("bucket").select("kind", "keys", "counts")
    return written(packed.mapInArrow(merge, COUNTED))


def _levels(kind: int, bucket: int, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
    level = np.frexp(n.astype(np.float64))[1] - 1
    return [(kind, bucket, int(j), int(at.sum()), int(n[at].sum()), _steps(keys[at]), _squeezed(n[at])) for j in np.unique(level) for at in [level == j]]


def low_orders(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of orders 0 and 1, 65,792 at most, summed over the tasks that have counted them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = _unstepped(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(_opened(n, "<i8"))], names=["kind", "key", "n"])

    found = counts.where("kind in (0, 1)").select("kind", "keys", "counts").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kinds, keys, n = (found[c].to_numpy() for c in ("kind", "key", "n"))
    return [_summed([keys[kinds == k].astype(np.uint64)], [n[kinds == k]]) for k in (0, 1)]


def least_levels(counts: DataFrame, limits: dict[int, int]) -> dict[int, int]:
    """For each kind the least level from which on its keys are no more than its limit."""
    by = counts.groupBy("kind", "level").agg(F.sum("n_keys").alias("n")).collect()  # 64 rows a kind at most
    least = {}
    for kind, limit in limits.items():
        have = {r["level"]: r["n"] for r in by if r["kind"] == kind}
        total, j = 0, max(have, default=0) + 1
        while j > 0 and total + have.get(j - 1, 0) <= limit:
            j -= 1
            total += have.get(j, 0)
        least[kind] = j
    return least


# --- values of asked keys ---------------------------------------------------------------------------

#: What a block asks: the keys of a bucket that it wants to know. Block _COUNTS has the counts, which come first.
ASKED = "kind int, bucket int, block long, keys binary, counts binary"
ANSWERED = "block long, kind int, bucket int, values binary"
_COUNTS = -1


def bucket_trie(keys: np.ndarray, counts: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """The whole trie as far as keys of one bucket need it, from the bucket's keys of the highest order, and orders 0 and 1."""
    orders = [(keys, counts)]
    for k in range(ORDER - 1, 1, -1):
        orders.append(_summed([orders[-1][0] & _mask(k + 1)], [orders[-1][1]]))
    return Trie([*low, *orders[::-1]])


def answered(counts: DataFrame, asked: DataFrame, low) -> DataFrame:  # noqa: ANN001  a broadcast
    """ANSWERED of asked (kind, bucket, block, keys), by the whole count table, a bucket at a time, in the order of the keys asked:
    log10 of a context's probability of its byte, as a 32-bit float, or how often a word occurs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, n, model = None, [], [], None
        for batch in batches:
            for i in range(len(batch)):
                kind, bucket, block, k, c = (batch.column(j)[i].as_py() for j in range(5))
                if (kind, bucket) != last:
                    last, keys, n, model = (kind, bucket), [], [], None
                if block == _COUNTS:
                    keys.append(_unstepped(k))
                    n.append(_opened(c, "<i8"))
                    continue
                k = _unstepped(k)
                if kind == ORDER:
                    model = model or bucket_trie(*_summed([_suffix_last(x) for x in keys], n), low.value)
                    k = _suffix_last(k)
                    values = np.concatenate([model.log10(k[a : a + 100_000]) for a in range(0, len(k), 100_000)]).astype("<f4")
                else:
                    model = model or _summed(keys, n)
                    at, there = _find(model[0], k)
                    values = np.where(there, model[1][at], 0).astype("<i8") if len(model[0]) else np.zeros(len(k), "<i8")
                keys, n = [], []
                yield _batch([(block, kind, bucket, _squeezed(values))], ANSWERED)

    table = counts.where(F.col("kind").isin(_TOKEN, ORDER)).select("kind", "bucket", F.lit(_COUNTS).cast("long").alias("block"), "keys", "counts")
    both = table.unionByName(asked.select("kind", "bucket", "block", "keys"), allowMissingColumns=True)
    return both.repartition("bucket").sortWithinPartitions("bucket", "kind", "block").mapInArrow(run, ANSWERED)


# --- scoring --------------------------------------------------------------------------------------

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Rows of a block: one of its documents (kind _DOCS), with what they want to know as numbers of the keys that the other rows ask.
BLOCKS = "kind int, bucket int, block long, keys binary, docs binary, n_deep long, deep binary, n_rare long, rare binary, rare_n binary"


class Block:
    """Documents of a block, scored as far as the task's own tables go."""

    def __init__(self, number: int):
        self.number, self.parts, self.docs = number, [], 0
        self.deep, self.rare = [], []

    def add(self, part: dict, deep: tuple[np.ndarray, np.ndarray], rare: tuple[np.ndarray, np.ndarray]) -> None:
        """`deep`, `rare`: document of the part and key of each byte and token beyond the tables."""
        self.parts.append(part)
        for into, (docs, keys) in ((self.deep, deep), (self.rare, rare)):
            into.append((docs + self.docs, keys))
        self.docs += len(part["doc_id"])

    def rows(self, buckets: int) -> pa.RecordBatch:
        asked, codes, sizes = [], [], []
        for kind, found in ((ORDER, self.deep), (_TOKEN, self.rare)):
            docs, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            distinct, which = np.unique(keys, return_inverse=True)
            order, some, ends = _dealt(kind, distinct, buckets)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            asked += [(kind, b, self.number, _steps(distinct[mine]), *[None] * 6) for b, mine in zip(some, np.split(order, ends), strict=False)]
            codes.append(docs * len(distinct) + place[which])
            sizes.append(len(distinct))
        deep = np.sort(codes[0]).astype(np.uint64)
        rare, times = np.unique(codes[1], return_counts=True)
        docs = pa.concat_batches([pa.RecordBatch.from_pydict(p) for p in self.parts])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(docs)
        return _batch([(_DOCS, None, self.number, None, sink.getvalue().to_pybytes(), sizes[0], _steps(deep), sizes[1], _steps(rare.astype(np.uint64)), _squeezed(times.astype(np.int64))), *asked], BLOCKS)


def _settled(row: dict, answers: dict[int, list[bytes]], scale: float, total: int) -> pa.RecordBatch:
    """A block's documents, with what the answers (of each kind, by bucket) add to their scores."""
    docs = pa.ipc.open_stream(row["docs"]).read_all()
    count = len(docs)

    def values(kind: int, form: str, expected: int) -> np.ndarray:
        found = np.concatenate([np.zeros(0, form), *[_opened(x, form) for x in answers.get(kind, [])]])
        if len(found) != expected:
            raise ValueError("a block has other answers than it has asked for")
        return found

    value = values(ORDER, "<f4", row["n_deep"])
    of, which = np.divmod(_unstepped(row["deep"]).astype(np.int64), max(1, row["n_deep"]))
    score = docs["score"].to_numpy() + np.bincount(of, value[which].astype(np.float64), count)
    n = values(_TOKEN, "<i8", row["n_rare"])
    of, which = np.divmod(_unstepped(row["rare"]).astype(np.int64), max(1, row["n_rare"]))
    times = _opened(row["rare_n"], "<i8")
    base = docs["base_score"].to_numpy() + np.bincount(of, times * (np.log10(n[which] + 1.0) - scale), count)
    known = docs["n_known"].to_numpy() + np.bincount(of, times * (n[which] > 0), count).astype(np.int64)
    columns = [docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), docs["n_tokens"].combine_chunks(), pa.array(known), pa.array(np.full(count, total)), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])


def _settle(scale: float, total: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, its documents first, then the answers of each kind by bucket; a task holds one block."""
        row, answers = None, {}
        for batch in batches:
            for i in range(len(batch)):
                kind = batch.column("kind")[i].as_py()
                if kind == _DOCS:
                    if row:
                        yield _settled(row, answers, scale, total)
                    row, answers = {c: batch.column(c)[i].as_py() for c in ("docs", "n_deep", "deep", "n_rare", "rare", "rare_n")}, {}
                else:
                    answers.setdefault(kind, []).append(batch.column("values")[i].as_py())
        if row:
            yield _settled(row, answers, scale, total)

    return run


@tidied
def score_documents(documents: DataFrame, held_mod: int = 7, held_rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Both models learn from all documents whose crc32(doc_id) modulo `held_mod` isn't `held_rest`; a null id is among them.
    Text is lower-cased (A-Z); null is empty: its end alone. Words are told apart by a 64-bit hash; a byte's log10 probability is a 32-bit float.
    A task holds the counts of the most frequent words and the values of the most frequent keys. For what is beyond them each
    block of documents asks the whole count table, once for each word or key it has; so the tables that a task holds change no score.
    Without training documents each word scores 0 and each byte 1 / 256. Repeated rows each give a row and count as often as they
    come; a very long text is a block of its own; other columns aren't read. Empty input gives no rows.
    """
    spark = documents.sparkSession
    counts = count_all(documents, held_mod, held_rest)
    whole = counts.where(F.col("kind") == _TOKEN).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("v")).first()
    total, scale = whole["n"], float(np.log10(whole["n"] + whole["v"] + 1))
    low, buckets = spark.sparkContext.broadcast(low_orders(counts)), _buckets(spark)
    least = least_levels(counts, {_TOKEN: MOST_COMMON, ORDER: MOST_ENTRIES})
    often = counts.where(F.col("kind") == ORDER).where(F.col("level") >= least[ORDER])
    asked = often.select("kind", "bucket", F.col("level").cast("long").alias("block"), "keys").toArrow().sort_by([("bucket", "ascending"), ("block", "ascending")])
    values = answered(counts, often.withColumn("block", F.col("level").cast("long")), low).toArrow().sort_by([("bucket", "ascending"), ("block", "ascending")])
    cached_keys = np.concatenate([np.zeros(0, np.uint64), *[_unstepped(x) for x in asked["keys"].to_pylist()]])
    cached_values = np.concatenate([np.zeros(0, "<f4"), *[_opened(x, "<f4") for x in values["values"].to_pylist()]])
    common = counts.where(F.col("kind") == _TOKEN).where(F.col("level") >= least[_TOKEN]).select("keys", "counts").toArrow()
    common = _summed([_unstepped(x) for x in common["keys"].to_pylist()], [_opened(x, "<i8") for x in common["counts"].to_pylist()])
    model = spark.sparkContext.broadcast((cached_keys, cached_values, *common))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        often_keys, often_values, common_keys, common_counts = model.value
        values = Table(often_keys, often_values)
        table = Table(common_keys, common_counts)
        block, held, beyond = Block(TaskContext.get().partitionId() << 32), 0, 0
        for batch in batches:
            for a, b, raw in text_parts(batch.column(2)):
                texts = [t.translate(LOWER) for t in raw]
                p = Packed(texts, LOWER, NON_SPACE)
                docs = np.concatenate([p.word_docs(), np.arange(b - a)])
                keys = np.concatenate([p.word_hashes(), np.full(b - a, END_TOKEN)])
                n, known = table.get(keys)
                base = np.bincount(docs, np.where(known, np.log10(n + 1.0) - scale, 0.0), b - a)
                contexts, begins = context_keys(texts)
                contexts = _suffix_first(contexts)
                value, found = values.get(contexts)
                sums = np.concatenate([[0.0], np.cumsum(np.where(found, value, 0.0), dtype=np.float64)])
                missing = np.flatnonzero(~found)
                part = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "held_out": batch.column(1).slice(a, b - a),
                    "n_tokens": np.diff(p.first) + 1,
                    "n_known": np.bincount(docs, known, b - a).astype(np.int64),
                    "base_score": base,
                    "score": sums[begins[1:]] - sums[begins[:-1]],
                }
                block.add(part, (np.searchsorted(begins, missing, "right") - 1, contexts[missing]), (docs[~known], keys[~known]))
                held += len(p.data)
                beyond += len(missing)
                if held >= BLOCK_TEXT or beyond >= BLOCK_KEYS:
                    yield block.rows(buckets)
                    block, held, beyond = Block(block.number + 1), 0, 0
        if block.docs:
            yield block.rows(buckets)

    held = F.coalesce(doc_remainder(F.col("doc_id"), held_mod) == held_rest, F.lit(False))
    blocks = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(score, BLOCKS))
    answers = answered(counts, blocks.where(F.col("kind") != _DOCS).select("kind", "bucket", "block", "keys"), low)
    of = blocks.where(F.col("kind") == _DOCS).drop("bucket", "keys")
    rows = of.unionByName(answers, allowMissingColumns=True).repartition("block")
    return rows.sortWithinPartitions("block", "kind", "bucket").mapInArrow(_settle(scale, total), OUT)
