"""Language ID by segmentation-marginalised unigrams.

Each language has piece probabilities over a fixed public vocabulary. A text's likelihood sums over all its
segmentations into pieces. No piece crosses a word boundary, so the sum factorises over words and a word's
likelihoods are worked out once and kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, doc_remainder, released

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the training sample: documents of a language, bytes of a sampled document's whole text.
SAMPLE_DOCS = 300
SAMPLE_TEXT_BYTES = 32 << 10
#: Characters of a longer text that teach: 4 bytes each at most.
RUN_CHARS = SAMPLE_TEXT_BYTES // 4
EM_ROUNDS = 4
#: Probability of a character that no piece covers, and the mass that smoothing gives each piece.
UNKNOWN = 1e-7
SMOOTH = 0.01
#: Words whose likelihoods a task keeps.
KEPT_WORDS = 150_000
#: Texts that a task holds as strings at once.
STEP_TEXTS = 128
#: Below this score a document's language counts as not known.
CONFIDENT = 0.5

#: Words of more characters are summed one by one, with rescaling.
LONG_WORD = 24
#: Words of one length that are summed at once in training.
STEP_WORDS = 2048
_KEY = np.uint64(0x100000001B3)

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: piece -> probability in each language; pieces that no language's sample uses are left out.
    pieces: dict[str, list[float]]
    priors: list[float]


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a public model file, without control and byte pieces; a leading ▁ marks a word's start."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def words_of(text: str) -> Counter:
    """Runs of letters in lower case, each with a mark of its start."""
    return Counter("▁" + w for w in _WORD.findall(text.lower()))


def has_letter(words: Iterable[str]) -> bool:
    return any(c.isalpha() for w in words for c in w[1:])


def _lattice(word: str, pieces: set | dict, longest: int) -> list[list[tuple[int, str]]]:
    """For each end, the (start, piece) that end there; a character without a piece stands alone."""
    out: list[list[tuple[int, str]]] = [[] for _ in range(len(word) + 1)]
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if (p := word[i:j]) in pieces:
                out[j].append((i, p))
        if word[i] not in pieces:
            out[i + 1].append((i, ""))
    return out


def expected_counts(word: str, n: int, prob: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """Adds n times each piece's expected number in the word, over all its segmentations (forward and backward sums)."""
    lattice = _lattice(word, prob, longest)
    size = len(word)
    # logarithms, since the products of a long word are below any double
    logs = [[(i, p, math.log(prob.get(p, UNKNOWN))) for i, p in ends] for ends in lattice]
    forward, ahead = [0.0] * (size + 1), [[] for _ in range(size + 1)]
    for j in range(1, size + 1):
        forward[j] = _log_sum([forward[i] + q for i, _, q in logs[j]])
        for i, _, q in logs[j]:
            ahead[i].append((j, q))
    backward = [0.0] * (size + 1)
    for i in range(size - 1, -1, -1):
        backward[i] = _log_sum([backward[j] + q for j, q in ahead[i]])
    for j in range(1, size + 1):
        for i, p, q in logs[j]:
            if p:
                into[p] = into.get(p, 0.0) + n * math.exp(forward[i] + q + backward[j] - forward[size])


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(x - top) for x in terms))


def _key(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_KEY) + ord(c)) % (1 << 64)
    return h


class PieceIndex:
    """Pieces by a hash of their characters, in arrays."""

    def __init__(self, pieces: Iterable[str]):
        order = sorted((_key(p), p) for p in pieces)
        self.names = [p for _, p in order]
        self.keys = np.array([k for k, _ in order] + [(1 << 64) - 1], np.uint64)
        self.longest = max(map(len, self.names), default=1)

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, number of the piece that each word has from i to j; the number of pieces if none), for words of one length."""
        size = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).T.astype(np.uint64)
        for i in range(size):
            key = np.zeros(len(words), np.uint64)
            for j in range(i, min(size, i + self.longest)):
                key = key * _KEY + chars[j]
                at = np.searchsorted(self.keys, key)
                yield i, j + 1, np.where(self.keys[at] == key, at, len(self.names))


def _expected_all(groups: list[tuple[list[str], np.ndarray]], index: PieceIndex, prob: np.ndarray) -> np.ndarray:
    """expected_counts() of groups of words of one length with their counts; prob ends with a 0 for no piece."""
    into = np.zeros(len(prob))
    for words, n in groups:
        size = len(words[0])
        forward, backward = np.zeros((2, size + 1, len(words)))
        forward[0] = backward[size] = 1.0
        spans = list(index.spans(words))
        alone = lambda i, j, q: np.where(q == 0, UNKNOWN, q) if j == i + 1 else q  # noqa: E731  a character without a piece
        for i, j, of in spans:
            forward[j] += forward[i] * alone(i, j, prob[of])
        for i, j, of in reversed(spans):
            backward[i] += backward[j] * alone(i, j, prob[of])
        share = n / np.maximum(forward[size], 1e-300)
        for i, j, of in spans:
            into += np.bincount(of, share * forward[i] * prob[of] * backward[j], len(prob))
    into[-1] = 0.0
    return into


def learn_pieces(words: Counter, vocab: set[str] | PieceIndex, longest: int, rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language by expectation-maximisation, from all words of its sample."""
    index = vocab if isinstance(vocab, PieceIndex) else PieceIndex(vocab)
    long = [(w, n) for w, n in sorted(words.items()) if len(w) > LONG_WORD]
    by_size: dict[int, list[tuple[str, int]]] = {}
    for w, n in sorted(words.items()):
        if w and len(w) <= LONG_WORD:
            by_size.setdefault(len(w), []).append((w, n))
    groups = [([w for w, _ in part], np.array([n for _, n in part], float)) for x in by_size.values() for a in range(0, len(x), STEP_WORDS) for part in [x[a : a + STEP_WORDS]]]
    count = np.zeros(len(index.names) + 1)
    number = {p: i for i, p in enumerate(index.names)}
    for group, n in groups:
        for _, _, of in index.spans(group):
            count += np.bincount(of, n, len(count))
    for w, n in long:
        for ends in _lattice(w, number, longest):
            for _, p in ends:
                if p:
                    count[number[p]] += n
    count[-1] = 0.0
    for _ in range(rounds):
        prob = np.where(count > 1e-4, count / (count.sum() or 1.0), 0.0)
        count = _expected_all(groups, index, prob)
        if long:
            table, found = {p: prob[i] for p, i in number.items() if prob[i] > 0}, {}
            for w, n in long:
                expected_counts(w, n, table, longest, found)
            for p, c in found.items():
                count[number[p]] += c
    return {index.names[i]: float(count[i]) for i in np.flatnonzero(count)}


def fit(samples: dict[str, list[str]], vocab: list[str], priors: dict[str, float]) -> LanguageModel:
    """A model of the languages of `samples`; all pieces that any language uses are smoothed in every language."""
    languages, index = sorted(samples), PieceIndex(vocab)
    counts = []
    for x in languages:
        words: Counter = Counter()
        for text in samples[x]:
            words.update(words_of(text))
        counts.append(learn_pieces(words, index, index.longest))
    used = sorted({p for c in counts for p, n in c.items() if n > 0.05})
    totals = [sum(c.get(p, 0.0) for p in used) + SMOOTH * len(used) for c in counts]
    pieces = {p: [(c.get(p, 0.0) + SMOOTH) / t for c, t in zip(counts, totals, strict=True)] for p in used}
    mass = sum(priors.get(x, 0.0) for x in languages) or 1.0
    return LanguageModel(languages, pieces, [max(priors.get(x, 0.0), 1e-9) / mass for x in languages])


def train(documents: DataFrame, held_mod: int = 4, held_rest: int = 2, vocab_path: str = VOCABULARY) -> LanguageModel:
    """Learn from text and non-null lang of the rows whose crc32(doc_id) mod `held_mod` isn't `held_rest`.

    A sample of at most SAMPLE_DOCS documents of a language, chosen by a hash of id and text, fits the pieces; priors are counts of all.
    Of a text above SAMPLE_TEXT_BYTES a run of RUN_CHARS is taken. Repeated rows are one before the driver reads the sample.
    """
    usable = documents.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(doc_remainder(F.col("doc_id"), held_mod) != held_rest)
    sized = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("different")).collect()  # a row a language
    counts = {r["lang"]: r["n"] for r in sized}
    if not counts:
        return LanguageModel([], {}, [])
    rate = F.create_map(*[F.lit(x) for r in sized for x in (r["lang"], int(1_000_000 * min(1.0, 1.3 * SAMPLE_DOCS / max(1, r["different"]))))])
    drawn = usable.withColumn("_o", F.xxhash64("doc_id", "text")).where(F.pmod("_o", F.lit(1_000_000)) < rate[F.col("lang")])
    start = F.pmod(F.col("_o"), F.greatest(F.length("text") - RUN_CHARS, F.lit(1))) + 1
    run = F.when(F.octet_length("text") <= SAMPLE_TEXT_BYTES, F.col("text")).otherwise(F.substring("text", start.cast("int"), RUN_CHARS))
    once = drawn.groupBy("lang", "_o").agg(F.first(run).alias("text"))
    rows = once.orderBy("_o", "lang", "text").limit(2 * SAMPLE_DOCS * len(counts)).collect()
    samples: dict[str, list[str]] = {x: [] for x in counts}
    for r in sorted(rows, key=lambda r: (r["_o"], r["text"])):
        if len(samples[r["lang"]]) < SAMPLE_DOCS:
            samples[r["lang"]].append(r["text"])
    total = sum(counts.values())
    return fit(samples, vocabulary(vocab_path), {k: n / total for k, n in counts.items()})


class Identifier:
    """Sums over segmentations with a trie of pieces; keeps each word's log-likelihoods."""

    def __init__(self, model: LanguageModel):
        self.model, self.n = model, len(model.languages)
        self.trie: dict = {}
        for p, probs in model.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = probs
        self.prior = np.log(np.array(model.priors))
        #: Row of each kept word in rows, its log-likelihoods.
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.n))
        self.index = PieceIndex(model.pieces)
        self.probs = np.array([model.pieces[p] for p in self.index.names] + [[0.0] * self.n]).reshape(len(self.index.names) + 1, self.n)

    def word(self, word: str) -> list[float]:
        """log of the sum, over all segmentations, of the product of piece probabilities; one for each language."""
        size, n, trie, longest = len(word), self.n, self.trie, self.index.longest
        rows: list[list[float] | None] = [None] * (size + 1)
        rows[0] = [1.0] * n
        shift = 0.0
        for i in range(size):
            here = rows[i]
            rows[i] = None
            if i and i % 24 == 0 and (top := max(here)) > 0:  # long words would underflow: rescale all rows that a piece has reached
                shift += math.log(top)
                here = [x / top for x in here]
                for r in rows[i + 1 : i + longest + 1]:
                    if r is not None:
                        r[:] = [x / top for x in r]
            node = trie
            for j in range(i, size):
                node = node.get(word[j])
                if node is None:
                    break
                probs = node.get("")
                if probs is not None:
                    there = rows[j + 1]
                    if there is None:
                        rows[j + 1] = [a * p for a, p in zip(here, probs)]
                    else:
                        rows[j + 1] = [t + a * p for t, a, p in zip(there, here, probs)]
            first = trie.get(word[i])
            if first is None or "" not in first:
                there = rows[i + 1] or [0.0] * n
                rows[i + 1] = [t + a * UNKNOWN for t, a in zip(there, here)]
        return [shift + (math.log(x) if x > 0 else -700.0) for x in rows[size]]

    def learn_words(self, words: Iterable[str]) -> None:
        """The sums of word() for many words at once: words of one length advance together, position by position."""
        by_size: dict[int, list[str]] = {}
        for w in dict.fromkeys(words):
            if w not in self.kept:
                by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            if size > LONG_WORD or len(group) < 16:
                self._keep(group, np.array([self.word(w) for w in group]))
                continue
            rows = np.zeros((size + 1, len(group), self.n))
            rows[0] = 1.0
            for i, j, of in self.index.spans(group):
                probs = self.probs[of]
                if j == i + 1:
                    probs = np.where(probs == 0, UNKNOWN, probs)  # smoothing leaves no piece a zero
                rows[j] += rows[i] * probs
            self._keep(group, np.log(np.maximum(rows[size], 1e-300)))

    def _keep(self, words: list[str], logs: np.ndarray) -> None:
        have = len(self.kept)
        while have + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[have : have + len(words)] = logs
        self.kept.update(zip(words, range(have, have + len(words)), strict=True))

    def identify(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior probability; und and 0 for a text that is null or has no letter."""
        return self.identify_words(words_of(text) if text else Counter())

    def identify_all(self, texts: pa.Array) -> Iterator[tuple[str, float]]:
        """identify() for a column of texts, in steps of so many that their new words are summed together."""
        for start in range(0, len(texts), STEP_TEXTS):
            counts = [words_of(x) if x else Counter() for x in texts.slice(start, STEP_TEXTS).to_pylist()]
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            if self.n:
                self.learn_words(w for c in counts for w in c)
            yield from map(self.identify_words, counts)
        released()

    def identify_words(self, words: Counter) -> tuple[str, float]:
        if not self.n or not has_letter(words):
            return "und", 0.0
        if not words.keys() <= self.kept.keys():
            self.learn_words(words)
        at = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
        total = self.prior + np.fromiter(words.values(), np.float64, len(words)) @ self.rows[at]
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify_languages(documents: DataFrame, model: LanguageModel, held_mod: int = 4, held_rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the whole text alone.

    Null text, or text without a letter, is `und` with score 0, and so is all text where no language could be learnt.
    A null id isn't held out; repeated rows each give a row; equal likelihoods go to the first language by code point. Very long texts are
    read whole; empty input gives no rows; other columns aren't read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in batches:
            found = list(identifier.identify_all(batch.column(2)))
            yield arrow_rows({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}, schema)

    held = F.coalesce(doc_remainder(F.col("doc_id"), held_mod) == held_rest, F.lit(False))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LanguageModel, confident: float = CONFIDENT) -> DataFrame:
    """The rows of documents, all columns as they are, whose language is known: not `und`, with a score of `confident` or more.

    Null text, and text without a letter, goes. Repeated rows and null ids are judged by their text alone; very long texts are read whole. Only
    the text is handed to Python, and only the decision comes back. Empty input gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(shared.value)
        for column in texts:
            yield pa.array([x != "und" and s >= confident for x, s in identifier.identify_all(column)], pa.bool_())

    return documents.where(known(F.col("text").cast("string")))
