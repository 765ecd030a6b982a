"""Ranked lexical search over K2-treaps of the grid of terms and documents.

The rows of the grid are the terms of the items, its columns the documents, and a point holds the impact
of a term on a document. Every task cuts its documents into shards and keeps the grid of a shard as a
K2-treap: a quadtree level by level, each cell with a mask of its filled quarters and the largest impact
inside it; ranks over the masks find the children, empty quarters take no room. The documents of a shard
are ordered by length, since lengths bound impacts.

An item descends along the rows of all its terms at once, over ranges of documents: the sum of the weighted
maxima of the cells in its rows bounds every score in the range. Ranges are halved best first, in
blocks, and left where the bound is below the score of the last of the best documents found by the task so
far; at the width of one document the sum is the score. The best of all tasks are then ranked. So the
result is that of scoring every document.

A document's length n, the number N of documents with a term and the number L of all terms count over all
rows. The weight of a term in df documents is w = floor(1000 ln((2N + 2) / (2 df + 1))); the impact of tf
occurrences is (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L; the score of a document is the
sum of w times impact over the terms of the item, repeats included.

Items are taken in blocks of bounded size, whose terms are broadcast; more items mean more passes.

Edge cases: terms are runs of digits, letters of ASCII and all characters beyond it; only A-Z are lower-cased.
Null and empty texts have no terms: as items they give no rows, as documents they are not counted. Every row
of the documents is a document, so a repeated row is ranked twice; a null id comes before all others. Equal
items (id and text) are one; items of one id with different texts, or with a null id, are each ranked on
their own. Equal scores are ranked by ascending id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.hashing import slices
from critiq.llm.rows import NO_ID
from critiq.session import written

#: Bytes of item texts whose terms are searched in one pass, about.
ITEM_BYTES = 8 << 20
#: Documents and points of a shard.
SHARD_DOCS, SHARD_POINTS = 1 << 14, 1 << 22
#: Bytes of text counted at once.
CHUNK_BYTES = 8 << 20
#: Ranges that are halved at once, and cells looked up for them.
BLOCK_RANGES, BLOCK_CELLS = 256, 1 << 18

POSTINGS = "id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, id bigint, score bigint"

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(0x80, 0x100))
#: Every byte of a term in lower case, every other one a blank.
_TERM_BYTES = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERM_BYTES).split() if text else []


class K2Treap:
    """Points of a grid of 2^height by 2^height, every cell of every level with its largest value.

    `maxima[l]`, `masks[l]` and `first[l]` belong to level l, from the root to the points. One empty cell
    ends every level and stands for all that are not there.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> None:
        self.height = height
        codes = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(codes)
        codes, values = codes[order], values[order]
        self.maxima, self.masks, self.first = [np.r_[values, 0]], [], []
        for _ in range(height):
            parents = codes >> np.uint64(2)
            starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(codes) else np.zeros(0, np.int64)
            quarters = np.left_shift(1, (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            masks = np.bitwise_or.reduceat(quarters, starts) if len(starts) else quarters
            values = np.maximum.reduceat(values, starts) if len(starts) else values
            self.masks.insert(0, np.r_[masks, np.uint8(0)])
            self.first.insert(0, np.r_[starts, len(codes)])
            self.maxima.insert(0, np.r_[values, 0])
            codes = parents[starts]

    def children(self, level: int, cells: np.ndarray, row_bits: np.ndarray, column_bit: int) -> np.ndarray:
        """The quarters of cells that lie in given rows and one half of the columns."""
        masks, quarter = self.masks[level][cells], (row_bits << 1) | column_bit
        there = (masks >> quarter) & 1
        place = self.first[level][cells] + _ONES[masks & ((1 << quarter) - 1)]
        return np.where(there, place, len(self.maxima[level + 1]) - 1)


_ONES = np.array([bin(x).count("1") for x in range(16)], np.int64)


def _spread(numbers: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at every other place."""
    x = numbers.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Best:
    """The k best documents of one item so far; equal scores by ascending id."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score a document needs to enter, by its id at equal ones."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def descend(treap: K2Treap, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Put the best documents of a shard for one item, whose rows and their weights are given, into `best`."""
    block = max(1, min(BLOCK_RANGES, BLOCK_CELLS // max(1, len(rows))))
    height = treap.height
    root = np.zeros((1, len(rows)), np.int64)
    stack = [(0, np.zeros(1, np.int64), root, treap.maxima[0][root] @ weights)]
    while stack:
        level, starts, cells, bounds = stack.pop()
        worth = bounds >= best.least
        if not worth.all():
            starts, cells, bounds = starts[worth], cells[worth], bounds[worth]
        if not len(starts):
            continue
        if level == height:
            best.add(bounds, ids[starts])
            continue
        row_bits = (rows >> (height - 1 - level)) & 1
        halves = [treap.children(level, cells, row_bits[None, :], bit) for bit in (0, 1)]
        cells = np.concatenate(halves)
        starts = np.concatenate([2 * starts, 2 * starts + 1])
        bounds = treap.maxima[level + 1][cells] @ weights
        order = np.argsort(-bounds, kind="stable")
        order = order[: int((bounds >= best.least).sum())]
        # the best block is on top of the stack
        for at in reversed(range(0, len(order), block)):
            part = order[at : at + block]
            stack.append((level + 1, starts[part], cells[part], bounds[part]))


def _count_terms(vocabulary) -> Callable:
    """Length of every document that has terms, and the counts of those that are in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = vocabulary.value.get
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, lengths, rows, counts, ends = [], [], [], [], [0]
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                found = Counter(map(row_of, words))
                found.pop(None, None)
                ids.append(number)
                lengths.append(len(words))
                rows.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(rows))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (rows, counts)]
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    return run


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of each count of a term in a document of given length."""
    m = 75 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, lengths, column, term, count) of the documents of each shard."""
    parts: list[pa.RecordBatch] = []
    docs = points = 0
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("terms").offsets))
        start = 0
        while start < batch.num_rows:
            room = int(np.searchsorted(np.cumsum(sizes[start:]), SHARD_POINTS - points, "right"))
            take = min(batch.num_rows - start, SHARD_DOCS - docs, room)
            if take <= 0 and docs == 0:
                take = 1
            if take > 0:
                parts.append(batch.slice(start, take))
                docs, points, start = docs + take, points + int(sizes[start : start + take].sum()), start + take
            if docs and (take <= 0 or docs >= SHARD_DOCS or points >= SHARD_POINTS):
                yield _joined(parts)
                parts, docs, points = [], 0, 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, lengths = (np.asarray(table.column(c)) for c in ("id", "n"))
    lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
    sizes = np.diff(np.asarray(lists[0].offsets))
    rows, counts = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
    order = np.argsort(-lengths, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    return ids[order], lengths[order], np.repeat(column, sizes), rows, counts


def _search(asked, n_rows: int, n_docs: int, n_terms: int, k: int) -> Callable:
    """The k best documents of a task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value
        best = [Best(k) for _ in items]
        for ids, lengths, columns, rows, counts in _shards(batches):
            values = impacts(counts, lengths[columns], n_docs, n_terms)
            height = max(1, int(max(n_rows, len(ids)) - 1).bit_length())
            treap = K2Treap(rows, columns, values, height)
            for found, (own_rows, weights) in zip(best, items):
                descend(treap, ids, own_rows, weights, found)
        for item, found in enumerate(best):
            if len(found.ids):
                columns = [np.full(len(found.ids), item, np.int32), found.ids, found.scores]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "id", "score"])

    return run


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, id, score, rank) for items (id, text) whose terms are held at once."""
    context = docs.sparkSession.sparkContext
    wanted = [Counter(terms(None if text is None else bytes(text))) for _, text in items]
    row_of = {term: row for row, term in enumerate(sorted(set().union(*wanted)))}
    postings = docs.mapInArrow(_count_terms(context.broadcast(row_of)), POSTINGS)
    postings = written(postings, "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.zeros(len(row_of), np.int64)
    for row, df in documents.items():
        weight[row] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    asked = []
    for counted in wanted:
        rows = np.array(sorted(row_of[term] for term in counted), np.int64)
        times = np.array([counted[t] for t in sorted(counted)], np.int64)
        weights = weight[rows] * times if len(rows) else times
        asked.append((rows[weights > 0], weights[weights > 0]))
    search = _search(context.broadcast(asked), len(row_of), n_docs, max(1, n_terms), k)
    found = postings.select("id", "n", "terms", "counts").mapInArrow(search, FOUND)
    first = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every item."""
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    asked = written(asked.where(F.octet_length("text") > 0), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = items.schema[item_col].dataType
    blocks = -(-size // ITEM_BYTES)
    result = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], _named_schema(kind))
        ranked = _rank_block(given, rows, k).join(F.broadcast(named), "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "score"
        )
        result = ranked if result is None else result.unionByName(ranked)
    if result is None:
        result = spark.createDataFrame([], "item_id " + kind.simpleString() + ", rank int, doc_id bigint, score bigint")
    return result


def _named_schema(kind) -> str:
    return f"item int, item_id {kind.simpleString()}"
