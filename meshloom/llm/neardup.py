"""Near-duplicates by ProbMinHash over sets of word shingles: sketches, bands, exact verification, classes.

Each shingle is a Poisson process whose rate is its weight; each arrival falls on a random register, and a register
keeps its earliest arrival. Two texts agree in a register with the probability Jaccard of their weighted shingles. All
weights are 1, so that it is the set similarity, by which links are defined, however often a shingle is repeated. A
document stops drawing when its next arrivals are later than the latest register. Copies are collapsed first, by a
fingerprint of all words: a node is a different text. Nodes that agree in a band are compared exactly, by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.components import linked, looked_up

from .common import LOWER, Packed, fresh, mixed, named, text_parts, tidied, written

WORDS = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 shares none of 32 bands of 5 registers with a probability of about 3e-6.
REGISTERS = 160
BAND = 5
#: Bits of the filter that says which documents' shingles are needed again: 4 MB.
FILTER_BITS = 1 << 25
#: Documents of a band that are compared in one group.
BLOCK = 512
#: Bands of more than this part of all rows are looked up without a shuffle; there are under 32 times as many.
HOT = 1000
#: Rows of one leader that a task compares with it.
SALT_ROWS = 512
#: Rounds in which bands of many texts in several classes are compared with a new leader, before all their pairs are.
LEADER_ROUNDS = 4
#: Up to so many ids of dropped rows are broadcast; beyond, they are joined.
MOST_BROADCAST_IDS = 1_000_000
_U = np.uint64


def weighted(docs: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document as 44-bit numbers, and their weights: all 1."""
    key = np.unique((docs.astype(np.uint64) << _U(44)) | (shingles >> _U(20)))
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), np.ones(len(key))


def sketches(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """A row of `registers` elements a document: those that arrive first. All processes advance an arrival a round."""
    earliest = np.full(n_docs * registers, np.inf)
    of = np.zeros(n_docs * registers, np.uint64)
    state = mixed(elements)
    at = np.zeros(len(docs))
    docs_left, elements_left, weights_left = docs, elements, weights
    while len(docs_left):
        state = mixed(state)
        at = at - np.log(((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights_left
        slot = docs_left * registers + (mixed(state ^ _U(0x5851F42D4C957F2D)) % _U(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, at)
        won = earliest[slot] == at
        of[slot[won]] = elements_left[won]
        latest = earliest.reshape(n_docs, registers).max(1)
        go = at < latest[docs_left]
        docs_left, elements_left, weights_left, state, at = (x[go] for x in (docs_left, elements_left, weights_left, state, at))
    return of.reshape(n_docs, registers)


def bands(rows: np.ndarray, band: int = BAND) -> np.ndarray:
    """A hash for each band of each row; bands of different places never agree."""
    n, m = rows.shape[0], rows.shape[1] // band
    h = np.broadcast_to(np.arange(1, m + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), (n, m))
    for j in range(band):
        h = mixed(h ^ rows[:, j : m * band : band])
    return h


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct numbers."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _prints(p: Packed, texts: int) -> list[np.ndarray]:
    """Two 64-bit numbers of each text's words in their order."""
    word, of = p.word_hashes(), p.word_docs()
    place = (np.arange(len(word)) - p.first[of]).astype(np.uint64)
    prints = [np.zeros(texts, np.uint64) for _ in range(2)]
    for j, x in enumerate(prints):
        np.add.at(x, of, mixed(word * _U(2 * j + 1) + mixed(place + _U(j << 40))))
    return prints


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sketched(documents: DataFrame, words: int, registers: int, band: int) -> DataFrame:
    """A row a document: doc_id, a 128-bit fingerprint of its words (f1, f2), and bands; without an id or words only doc_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b, raw in text_parts(batch.column(1)):
                texts = [t if ok else b"" for t, ok in zip(raw, named[a:b], strict=True)]
                p = Packed(texts, LOWER)
                docs, elements, weights = weighted(*p.shingles(words))
                band_hashes = bands(sketches(docs, elements, weights, b - a, registers), band).view(np.int64)
                some = np.diff(p.first) > 0
                flat, m = band_hashes[some].ravel(), band_hashes.shape[1]
                ends = np.concatenate([[0], np.cumsum(some) * m]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                prints = [pa.array(x.view(np.int64), mask=~some) for x in _prints(p, b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *prints, lists], names=["doc_id", "f1", "f2", "bands"])

    return _rows(documents).mapInArrow(run, "doc_id long, f1 long, f2 long, bands array<long>")


def _shingles_of(documents: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and the sorted 32-bit hashes of the distinct shingles of `nodes` (node, exact_id, f1, f2), written.

    A bitmap of FILTER_BITS, gathered by words of 64 bits, tells which documents to take; the more nodes there are, the more
    others pass, which costs their work but changes no result.
    """
    place = F.pmod(F.xxhash64("exact_id"), F.lit(FILTER_BITS))
    bits = nodes.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("m"))
    found = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
    bitmap[found["w"].to_numpy()] = found["m"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            taken = batch.column(0).filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1))
            for a, b, texts in text_parts(taken):
                p = Packed(texts, LOWER)
                docs, hashes = p.shingles(words)
                # 32 bits of a shingle are enough to compare two documents
                key = np.unique((docs.astype(np.uint64) << _U(32)) | (hashes >> _U(32)))
                cut = np.searchsorted(key >> _U(32), np.arange(b - a + 1).astype(np.uint64))
                small = (key & _U(0xFFFFFFFF)).astype(np.uint32)
                sets = pa.array([small[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in _prints(p, b - a)], sets], names=["f1", "f2", "shingles"])

    rows = _rows(documents).where("doc_id is not null and text is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    sets = rows.select("text", place.alias("at")).mapInArrow(run, "f1 long, f2 long, shingles binary").dropDuplicates(["f1", "f2"])
    return written(sets.join(nodes.select("node", "f1", "f2"), ["f1", "f2"]).select("node", "shingles"))


def _verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), written, whose shingle sets have a Jaccard similarity of `least` or more; no b has two a.

    An a of many pairs has its shingles copied for each SALT_ROWS of them, so that they are compared in many tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(j).to_pylist() for j in (2, 3))
            ok = [min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least - 1e-9 for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("copies"))
    of_a = shingles.toDF("a", "sa").join(copies, "a")
    of_a = of_a.select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    salted = looked_up(pairs, "a", copies).select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("salt"))
    both = salted.join(shingles.toDF("b", "sb"), "b").join(of_a, ["a", "salt"])
    return written(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _labelled(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(h, node, n, label), written, of the bands whose nodes are of several classes."""
    known = written(shared.select("h", "node", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    several = known.groupBy("h").agg((F.min("label") < F.max("label")).alias("several")).where("several")
    return written(looked_up(known, "h", several).where("several").drop("several"))


def _led(rows: DataFrame, salt: int) -> DataFrame:
    """(a, b), written: of the bands (h, node, label) one that has a leader of another class than b, and its leader a."""
    leader = rows.groupBy("h").agg(F.min(_drawn(F.col("node"), salt, "label")).alias("chief"))
    met = looked_up(rows, "h", leader).where("chief.d <> node and chief.label <> label")
    return written(met.groupBy(F.col("node").alias("b")).agg(F.min(F.struct(F.xxhash64("chief.d", F.lit(salt)).alias("h"), F.col("chief.d").alias("d")))["d"].alias("a")).select("a", "b"))


def _linked_in_bands(members: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Links (a, b), written, that join what the pairs of each band join, of the bands of _labelled.

    All pairs of a band are compared exactly, but only links that join two classes become rows. A band of more than
    BLOCK nodes is cut into blocks, and each two blocks are a group.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", "h"), blocks).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label").join(shingles, "node")
    groups = rows.select("h", "i", "j", "mine", "node", "label", "shingles").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            a, b = _links_of_group(pa.Table.from_batches(held), least)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            h, i, j = (batch.column(c).to_numpy() for c in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[: len(h)]
            for x, y in zip(starts, [*starts[1:], len(h)], strict=True):
                if held and (h[x], i[x], j[x]) != last:
                    yield solve()
                held.append(batch.slice(x, y - x))
                last = (h[x], i[x], j[x])
        if held:
            yield solve()

    return written(groups.mapInArrow(run, "a long, b long").distinct())


def _links_of_group(group: pa.Table, least: float) -> tuple[list[int], list[int]]:
    """A forest of links between classes: of nodes of one block, or across two."""
    docs, labels, mine = (group[c].to_numpy() for c in ("node", "label", "mine"))
    across = group["i"][0].as_py() != group["j"][0].as_py()
    sets = [np.frombuffer(x, np.uint32) for x in group["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of one document alone are in no intersection
    number = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    of, at = of[keep], number[at[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 8192):
        part = (at >= low) & (at < low + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[of[part], at[part] - low] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    close = np.triu(common >= (least - 1e-9) * union, 1) & (labels[:, None] != labels[None, :])
    if across:
        close &= mine[:, None] != mine[None, :]
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for p, q in zip(*(k.tolist() for k in np.nonzero(close)), strict=True):
        x, y = find(labels[p]), find(labels[q])
        if x != y:
            root[max(x, y)] = min(x, y)
            a.append(int(docs[p]))
            b.append(int(docs[q]))
    return a, b


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label), written, after links join classes; nodes that are no row of label are classes of their own."""
    return _classed(links.select("a", "b").unionByName(label.toDF("a", "b")))


def _classed(links: DataFrame) -> DataFrame:
    return linked(links).toDF("node", "label")


def _drawn(node: Column, salt: int, *more: str) -> Column:
    return F.struct(F.xxhash64(node, F.lit(salt)).alias("h"), node.alias("d"), *more)


def _shared(bucket: DataFrame, leader: DataFrame, most: int) -> DataFrame:
    """(h, node, leader, n): rows (node, h) of the bands that `leader` (h, leader, n) has, one row a band. Bands of over `most` nodes are broadcast.

    Either join gives each row of the bands once, whatever the sizes of groups; rows that have their leader go to the second by a hash of their own.
    """
    hot = F.broadcast(leader.where(F.col("n") > most)).select("h", F.struct("leader", "n").alias("led"))
    first = bucket.join(hot, "h", "left").withColumn("key", F.when(F.col("led").isNull(), F.col("h")).otherwise(F.xxhash64("node", "h")))
    rest = leader.select(F.col("h").alias("key"), F.struct("leader", "n").alias("cold"))
    return first.join(rest, "key", "left").select("h", "node", F.coalesce("led", "cold").alias("led")).where("led is not null").select("h", "node", "led.leader", "led.n")


def _grouped(documents: DataFrame, copies: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, label), written, of the nodes that a link or a label names; `copies` has a row a node with its bands."""
    node = F.col("node")
    bucket = copies.select("node", F.explode("bands").alias("h"))
    leader = bucket.groupBy("h").agg(F.min(_drawn(node, 0))["d"].alias("leader"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(node, F.lit(1))).alias("x"), F.sum(F.xxhash64(node, F.lit(2)).bitwiseAND(0xFFFFFFFF)).alias("s"))
    # bands of the same nodes are one
    leader = written(leader.where("n > 1").groupBy("n", "x", "s", "leader").agg(F.min("h").alias("h")).select("h", "leader", "n"))
    shared = written(_shared(bucket, leader, max(HOT, copies.count() // HOT)))
    met = written(shared.where("leader <> node").groupBy(node.alias("b")).agg(F.min(_drawn(F.col("leader"), 0))["d"].alias("a")).select("a", "b"))
    near = written(copies.select("node", "exact_id", "f1", "f2").join(shared.select("node").distinct(), "node", "left_semi"))
    shingles = _shingles_of(documents, near, words)
    label = _classed(_verified(met, shingles, similarity))
    open_bands = _labelled(shared, label)
    for salt in range(1, LEADER_ROUNDS + 1):
        many = open_bands.where(F.col("n") > BLOCK)
        if many.isEmpty():
            break
        links = _verified(_led(many, salt), shingles, similarity)
        if links.isEmpty():
            break
        label = _joined(label, links)
        open_bands = _labelled(open_bands, label)
    return _joined(label, _linked_in_bands(open_bands, shingles, similarity))


@tidied
def classes(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """doc_id, class_id, exact_id for every row: class_id is the least doc_id of a class of near-duplicates.

    A class is a connected component of the links between texts whose sets of `words`-word shingles have a Jaccard
    similarity of `similarity` or more; words are runs of letters and digits without regard to case A-Z. exact_id is the least
    doc_id of the documents of the same words. A text of fewer words, but not none, is one shingle; very long texts are taken whole. Null text and
    text without words are like nothing: their class is their own doc_id; so is that of a null id. Repeated rows each give
    a row. Rows of one doc_id with different texts are texts of one document: they are of one class, and the exact_id is the least
    of theirs. Empty input gives no rows. Other columns aren't read.

    Each text is first compared with one leader of its bands. Bands of very many texts that are then of several classes try other
    leaders. Where the texts of a band are still of several classes, all its pairs are compared. So two texts that
    share a band and are similar are always of one class.
    """
    sketched = written(_sketched(documents, words, registers, band))
    some = sketched.where("f1 is not null")
    # each different text once
    copies = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("exact_id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    label = _grouped(documents, copies, words, similarity)
    member = written(looked_up(some.select("doc_id", F.struct("f1", "f2").alias("f")), "f", copies.select(F.struct("f1", "f2").alias("f"), F.struct("node", "exact_id").alias("t")), some.select(F.struct("f1", "f2").alias("f"))).select("doc_id", "t.*").distinct())
    # a document of several texts links their classes
    several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("doc_id", "b")
    more = written(looked_up(member, "doc_id", several).where("b is not null").select(F.col("node").alias("a"), "b"))
    if not more.isEmpty():
        label = _joined(label, more)
    known = written(copies.select("node", "exact_id").join(label, "node", "left").select("node", "exact_id", F.coalesce("label", "node").alias("label")))
    least = known.groupBy("label").agg(F.min("exact_id").alias("class_id"))
    of_node = looked_up(known, "label", least).select("node", "class_id")
    of = written(looked_up(member, "node", of_node).select("doc_id", "class_id", "exact_id"))
    one = of.groupBy("doc_id").agg(F.struct(F.min("class_id").alias("class_id"), F.min("exact_id").alias("exact_id")).alias("o"))
    return looked_up(sketched.select("doc_id"), "doc_id", one).select("doc_id", F.coalesce("o.class_id", "doc_id").alias("class_id"), F.coalesce("o.exact_id", "doc_id").alias("exact_id"))


def drop_near_duplicates(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents, all columns as they are, that stay: of each class the rows of the least doc_id.

    Rows of null id stay, and so do null texts and texts without words. Of rows of one id and equal text one stays, the
    one whose other columns come first as JSON; an id's different texts all stay. Empty input gives no rows.
    """
    of = written(classes(documents, words, similarity).where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).where("class_id <> doc_id or n > 1"))
    near, again, rest = fresh(documents, "near_id", "near_again", "near_rest")
    flagged = of.select(F.col("doc_id").alias(near), (F.col("class_id") == F.col("doc_id")).alias(again))
    if of.count() <= MOST_BROADCAST_IDS:
        flagged = F.broadcast(flagged)
    rows = documents.join(flagged, F.col("doc_id") == F.col(near), "left")
    columns = [named(c) for c in documents.columns]
    one = rows.where(F.col(again)).groupBy("doc_id", "text").agg(F.min_by(F.struct(columns), F.to_json(F.struct(columns))).alias(rest))
    return rows.where(F.col(near).isNull()).select(columns).unionByName(one.select(f"{rest}.*"))
