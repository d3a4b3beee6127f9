"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, doc_remainder, text_parts

#: Bounds of the labelled sample that the classifier is fitted on: rows of a class, and bytes of a sampled row's whole text.
SAMPLE_ROWS = 1500
SAMPLE_TEXT_BYTES = 32 << 10
#: Bytes of a dictionary, which all sampled texts of a class share.
DICT_BYTES = 1 << 20
LEVEL = 6
#: The whole text is compressed in pieces of so many bytes; in longer ones its own repeats hide what a dictionary gives.
PIECE_BYTES = 400
#: A score at or above this predicts label 1.
THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionClassifier:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


class Scorer:
    """Compressors of both dictionaries and of none."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=_raw(d), **plain) for d in (good, bad))
        self.none = zstandard.ZstdCompressor(**plain)

    def features(self, text: bytes) -> np.ndarray:
        """1; the size difference over the larger size; the sizes with the good, the bad and no dictionary over the length."""
        pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        a, b = (sum(len(c.compress(p)) for p in pieces) for c in (self.good, self.bad))
        n = len(text)
        return np.array([1.0, (b - a) / max(a, b), a / n, b / n, len(self.none.compress(text)) / n])


def _raw(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return d


def _dictionary(texts: list[bytes]) -> bytes:
    """Of every text the same number of bytes, from its middle, or all of a shorter one: as many as fit DICT_BYTES."""
    left, each = DICT_BYTES - len(texts), 0
    for i, n in enumerate(sorted(map(len, texts))):
        each = left // (len(texts) - i)
        if n > each:
            break
        left, each = left - n, n
    parts = [t[max(0, (len(t) - each) // 2) :][:each] for t in texts]
    return b"\n".join(parts).ljust(64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; a step is halved while it makes the loss worse."""

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -40, 40)
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(good: list[bytes], bad: list[bytes], prior: float) -> CompressionClassifier:
    """Calibrated by two folds: each half is measured with dictionaries of the other; the final ones are of all texts.

    `prior` is the share of label 1 that scores are calibrated to. With a class of no text, all texts score the prior.
    """
    odds = float(np.log(prior / (1 - prior)))
    if len(good) < 2 or len(bad) < 2:
        return CompressionClassifier(_dictionary(good), _dictionary(bad), (odds, 0.0, 0.0, 0.0, 0.0), prior)
    x, y = [], []
    for k in (0, 1):
        s = Scorer(_dictionary(good[k::2]), _dictionary(bad[k::2]))
        for label, texts in ((1.0, good[1 - k :: 2]), (0.0, bad[1 - k :: 2])):
            x += [s.features(t) for t in texts]
            y += [label] * len(texts)
    labels = np.array(y)
    w = _logistic(np.array(x), labels)
    w[0] += odds - np.log(labels.mean() / (1 - labels.mean()))
    return CompressionClassifier(_dictionary(good), _dictionary(bad), tuple(map(float, w)), prior)


def train(documents: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, sample_rows: int = SAMPLE_ROWS) -> CompressionClassifier:
    """Fit on a bounded sample of labelled rows, chosen by a hash of the id: at most `sample_rows` of each class,
    none over SAMPLE_TEXT_BYTES long. All that are sampled are in the dictionaries and in the calibration.

    Labels of ids with crc32 mod `held_mod` equal to `held_rest` are never read. Null labels, ids and texts take no part;
    an id labelled twice has the larger label. The prior comes from all training labels.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(doc_remainder(F.col("doc_id"), held_mod) != held_rest)
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    counts = {r["_q"]: r["count"] for r in chosen.groupBy("_q").count().collect()}
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
    by: dict[int, list[bytes]] = {}
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    picked = None
    for q in (0, 1):
        rate = int(min(1.0, 1.5 * sample_rows / max(1, counts.get(q, 0))) * 1_000_000)
        part = chosen.where((F.col("_q") == q) & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < rate)).orderBy(F.xxhash64("_id"), "_id").limit(2 * sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    # picked has at most 4 * sample_rows ids, so it is broadcast; an id of several texts counts once
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_q").agg(F.min("_t").alias("_t")).orderBy(F.xxhash64("_id"), "_id").collect()
    for q in (0, 1):
        by[q] = [r["_t"].encode() for r in rows if r["_q"] == q and r["_t"]][:sample_rows]
    return fit(by[1], by[0], prior)


def score_quality(documents: DataFrame, model: CompressionClassifier, held_mod: int = 5, held_rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text alone.

    Null or empty text scores the prior; very long texts are compressed whole. A null id isn't held out; repeated rows each give a row;
    empty input gives no rows; other columns aren't read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, weights = Scorer(m.good, m.bad), np.array(m.weights)
        for batch in batches:
            score = [float(_sigmoid(scorer.features(x) @ weights)) if x else m.prior for _, _, texts in text_parts(batch.column(2)) for x in texts]
            yield arrow_rows({"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": [int(x >= THRESHOLD) for x in score]}, schema)

    held = F.coalesce(doc_remainder(F.col("doc_id"), held_mod) == held_rest, F.lit(False))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
