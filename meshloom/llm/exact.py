"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

The first pass counts, for each cell of a Bloom filter, the rows that set it; a cell that two rows or more set goes into the
filter. The set cells are sent rather than a whole filter a task, since tasks x filter is far more. The second pass looks each
row's cells up in that filter: a row of which a cell isn't there has a text of its own and passes straight through. Only the
others, copies and a few false hits, are shuffled by their whole hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, tidied, written

#: Cells that each row sets, in one block.
HASHES = 2
#: Cells a row, rounded up to a power of two, and the most that a filter has: 64 MB, which are broadcast. More rows than that serves
#: fill it, so that more of them are shuffled; the result stays the same.
CELLS_A_ROW = 16
MOST_CELLS = 1 << 29
#: Words of 64 cells in a block.
BLOCK_WORDS = 128
_BLOCK = 64 * BLOCK_WORDS
#: A group of more than this part of the rows that are looked up is broadcast; there are fewer of them than this.
HOT = 1000


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _cells(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """A row's block, and its cells there: from the high and the low half of a hash."""
    h = F.xxhash64(F.col(key))
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)), [F.shiftrightunsigned(h, 13 * j).bitwiseAND(F.lit(_BLOCK - 1)).cast("int") for j in range(HASHES)]


def repeated_cells(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): the first pass. A bit is set where two rows or more have that cell; blocks of no such bit have no row."""
    block, cells = _cells(key, blocks)
    each = rows.select(block.alias("block"), F.explode(F.array_distinct(F.array(*cells))).alias("cell"))
    twice = each.groupBy("block", "cell").count().where("count > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell").bitwiseAND(F.lit(63)))
    word = twice.groupBy("block", F.shiftright("cell", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    held = word.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("held"))  # up to BLOCK_WORDS a block
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("words"))


@dataclass(frozen=True)
class RepeatFilter:
    """The filter that the first pass leaves, of so many blocks: MOST_CELLS / 8 bytes at most, so that it is broadcast."""

    key: str
    cells: DataFrame
    blocks: int

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The second pass: rows whose key no other row has, surely, and those whose key may be repeated. Lazy; together all rows.

        All rows of a repeated key are in the second part.
        """
        block, words = fresh(rows, "block", "words")
        at, places = _cells(self.key, self.blocks)
        tested = rows.withColumn(block, at).join(F.broadcast(self.cells.toDF(block, words)), block, "left")
        hit = F.lit(True)
        for x in places:
            hit = hit & (F.getbit(F.get(F.col(words), F.shiftright(x, 6)), x.bitwiseAND(F.lit(63))) == 1)
        hit = F.coalesce(hit, F.lit(False))
        columns = [named(c) for c in rows.columns]
        return tested.where(~hit).select(columns), tested.where(hit).select(columns)


def repeat_filter(rows: DataFrame, key: str, most_cells: int = MOST_CELLS) -> RepeatFilter:
    """The first pass over rows, which should be a written table of few columns."""
    cells, wanted = _BLOCK, CELLS_A_ROW * rows.count()
    while cells < min(wanted, most_cells):
        cells *= 2
    return RepeatFilter(key, written(repeated_cells(rows, key, cells // _BLOCK)), cells // _BLOCK)


def with_group(rows: DataFrame, key: str, groups: DataFrame, n: str) -> DataFrame:
    """rows, left-joined with groups (key, its number of rows n, ...), which is written and of unique keys.

    Groups of more than a HOT-th of all rows are looked up by broadcast, so that no key brings many rows to one task.
    """
    bound = max(HOT, (groups.agg(F.sum(n)).first()[0] or 0) // HOT)
    rest = [c for c in groups.columns if c != key]
    hot = rows.join(F.broadcast(groups.where(F.col(n) > bound)), key, "left")
    cold = hot.where(F.col(n).isNull()).select([named(c) for c in rows.columns]).join(groups.where(F.col(n) <= bound), key, "left")
    columns = [*rows.columns, *rest]
    return hot.where(F.col(n).isNotNull()).select([named(c) for c in columns]).unionByName(cold.select([named(c) for c in columns]))


@tidied
def exact_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex) for every row.

    Rows of equal texts are a group; the one of the largest doc_id stays, and of several rows of that id one. Null text is equal to an
    empty one. A null id comes before all others, so that its row stays only in a group of null ids. Very long texts are hashed whole.
    Empty input gives no rows. Other columns aren't read.
    """
    rows = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("row")))
    alone, maybe = repeat_filter(rows, "sha").split(rows)
    maybe = written(maybe)
    groups = written(maybe.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last")).where("n > 1"))
    known = with_group(maybe, "sha", groups, "n")
    one = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    many = known.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"), "sha")
    return one.unionByName(many).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, all columns as they are: lazy. A row that the filter doesn't name goes on without a shuffle.

    Of rows of one text and the id that stays, the one whose other columns come first as JSON. Null text is equal to an empty one, and a
    null id comes before all others. Empty input gives no rows.
    """
    sha, doc, n, last = fresh(documents, "sha", "doc", "n", "last")
    rows = documents.withColumn(sha, text_hash(F.col("text"))).withColumn(doc, F.col("doc_id").cast("long"))
    narrow = written(rows.select(sha, doc))
    found = repeat_filter(narrow, sha)
    groups = written(found.split(narrow)[1].groupBy(sha).agg(F.count("*").alias(n), F.max(F.struct(doc)).alias(last)).where(F.col(n) > 1))
    alone, maybe = found.split(rows)
    known = with_group(maybe, sha, groups, n)
    columns = [named(c) for c in documents.columns]
    stay = known.where(F.col(n).isNotNull() & F.col(f"{last}.{doc}").eqNullSafe(F.col(doc)))
    first = stay.groupBy(sha).agg(F.min_by(F.struct(columns), F.to_json(F.struct(columns))).alias(last))
    return alone.select(columns).unionByName(known.where(F.col(n).isNull()).select(columns)).unionByName(first.select(f"{last}.*"))
