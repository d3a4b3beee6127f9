"""What each filter of a cascade removes in every order, by the multilinear extension of the removal count and its Shapley values.

A document is the set of filters that it fails, a bit mask. For one part of the corpus, F(x) is the number of documents removed
when filter i acts with probability x_i: a sum over masks of count * (1 - product of (1 - x_i) over the mask), which is a polynomial
linear in each variable. Its corners say what any set of filters removes, so its differences along an order say what each step
does; the integral of its partial derivative along the diagonal is the filter's Shapley value. Both are exact: coefficients are whole
and integrals are rationals, whose multiple by the number of orders is whole. Only mask counts leave Spark's grouped sums, at
most 32 a part, and each part's polynomial is worked out in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidied, written
from .exact import repeat_filter, text_hash, with_group

FILTERS = "ABCDE"
_WORD = "[^\\x20\\x09-\\x0D]+"


def text_failures(text: Column, words: Column) -> list[Column]:
    """What the text alone says, filters A to D: too short, repetitive, shouting, symbols. `words`: its words."""
    n = F.size(words)
    return [
        n < 200,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(3).cast("long") * F.char_length(text),
        F.regexp_like(text, F.lit("[#$%&*|]")),
    ]


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row: bit i of mask is set if the document fails filter i of ABCDE; written.

    E, a copy of a smaller doc_id's text anywhere in the table, is asked only for rows whose text may be repeated (two-pass Bloom
    filter); texts are read once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = read.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(text_failures(F.col("text"), F.col("words")))), F.lit(0))
    rows = written(split.select("doc_id", "part", mask.alias("mask"), text_hash(F.col("text")).alias("sha")))
    alone, maybe = repeat_filter(rows, "sha").split(rows)
    maybe = written(maybe)
    groups = written(maybe.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    copies = with_group(maybe, "sha", groups, "n").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0))
    return written(alone.select("doc_id", "part", "mask").unionByName(copies.select("doc_id", "part", "mask")))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those whose id has a label of quality 1, of toxic 1.

    Rows of one id, part and mask are summed before they meet the labels, so that an id that is repeated very often is few rows.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    every = failed.groupBy("part", "mask").agg(F.count("*").alias("n"))
    marked = failed.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks.where("good + toxic > 0"), "doc_id")
    sums = marked.groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return every.join(sums, ["part", "mask"], "left").na.fill(0, ["good", "toxic"])


def removal_polynomial(counts: Mapping[int, int]) -> dict[int, int]:
    """Coefficients of F by the set of variables, a mask: 1 - product of (1 - x_i) over m is the sum over S in m of (-1)^(|S|+1) x_S."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        s = mask
        while s:  # every set within the mask but the empty one
            out[s] = out.get(s, 0) + (n if s.bit_count() % 2 else -n)
            s = (s - 1) & mask
    return out


def removed_by(polynomial: Mapping[int, int], filters: int) -> int:
    """F at a corner: what these filters remove together."""
    return sum(c for s, c in polynomial.items() if s & filters == s)


def shapley_value(polynomial: Mapping[int, int], i: int) -> Fraction:
    """The integral from 0 to 1 of dF/dx_i at (t, ..., t): each set S with i gives c * t^(|S|-1), so c / |S|."""
    return sum((Fraction(c, s.bit_count()) for s, c in polynomial.items() if s >> i & 1), Fraction())


_KINDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_FORM = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(x, pa.int64()) for x in _KINDS]])


def part_rows(part: str, counts: list[dict], filters: str = FILTERS) -> Iterator[tuple]:
    """A row for each order of the filters and step in it."""
    n, good, toxic = (removal_polynomial({r["mask"]: r[k] for r in counts}) for k in ("n", "good", "toxic"))
    total, every = sum(r["n"] for r in counts), (1 << len(filters)) - 1
    corner = [[removed_by(p, s) for s in range(every + 1)] for p in (n, good, toxic)]
    orders = math.factorial(len(filters))
    value = [shapley_value(n, i) * orders for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order):
            after = before | 1 << i
            gone = [c[after] - c[before] for c in corner]
            unique = corner[0][every] - corner[0][every & ~(1 << i)]
            yield part, "".join(filters[x] for x in order), step + 1, total - corner[0][after], gone[0], corner[0][1 << i] - gone[0], unique, gone[1], gone[2], int(value[i])
            before = after


@tidied
def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang, null as the empty string), order of ABCDE and step, with what its filter does there.

    kept after the step, removed in it, redundant: fails the filter but was removed before, unique_fails: fails no other filter; good_lost and
    toxic_lost: removed here with a label of quality 1, of toxic 1; shapley: removed by the filter, summed over all orders.
    Null text is empty: it fails A. Copies of equal ids don't fail E, and a null id neither fails it nor makes another fail. An id with several
    labels is good or toxic if one says so. Very long texts are judged whole. Empty documents give no rows, empty labels lose none. Other columns aren't read.
    """
    parts = mask_counts(failures(documents), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 a part at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = zip(*part_rows(part, counts), strict=True)
                yield arrow_rows(dict(zip(_FORM.names, map(list, columns), strict=True)), _FORM)

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in _KINDS))
