"""Nearest neighbours by a block matrix join: int8 tiles bound every cosine, survivors are recomputed.

Queries and candidates are dealt into slices of bounded size. A pair of slices is a tile, worked on by
one task. Within a tile every vector is scaled to length 1 and rounded to int8 with a step of its
own; with e the length of what rounding left, a cosine is known up to

    |cos(a, b) - step_a step_b (a8 . b8)| <= e_a + |step_a a8| e_b.

The products a8 . b8 are whole numbers, exact in single precision for up to 1,024 components at a time.
A candidate is left out only where its upper bound is below the lower bounds of k + 1 others; for
the rest the cosine is computed in double precision from the vectors as given, and a heap per
query keeps the best. The heaps of all tiles of a query are merged in one pass over sorted rows. So the
result is that of a comparison of all pairs; recall is 1.

Equal vectors of a slice are compared once. Only the k + 1 smallest ids of equal vectors can be among the
k nearest of anything, so a vector that a third of all rows share costs no more than any other.

Edge cases: vectors that are null, empty, zero or hold a null, NaN or infinity take no part, nor do rows
with a null id. Vectors are compared with those of the same number of components. Repeated rows (id and
vector) count once; rows of one id with different vectors are searched and found each on its own. Equal
scores go to the smaller id. With fewer than k candidates all are returned; a query without any has
no row. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.session import written

#: Bytes of vectors (single precision) in a slice, about.
SLICE_BYTES = 32 << 20
#: Vectors of a slice that are enough to keep a task busy.
LEAST_ROWS = 2048
#: Queries and candidates whose products are held at once.
QUERY_STEP, CANDIDATE_STEP = 512, 4096
#: Components whose int8 products add up exactly in single precision.
EXACT_COMPONENTS = 1024
#: Room for the rounding of the bounds themselves.
SLACK = 1e-9

FOUND = "query_id bigint, query_key bigint, ids array<bigint>, scores array<double>"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _by_length(rows: pa.Table) -> Iterator[tuple[int, "Slice"]]:
    """The vectors of each length."""
    if not rows.num_rows:
        return
    ids, keys, lists = (rows.column(c).combine_chunks() for c in ("id", "key", "vector"))
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    lengths = np.diff(offsets)
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        matrix = values[offsets[own][:, None] + np.arange(length)]
        yield length, Slice(np.asarray(ids)[own], np.asarray(keys)[own], matrix)


class Slice:
    """The different vectors of a slice with their ids, exact and rounded."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, matrix: np.ndarray) -> None:
        matrix = matrix + 0.0  # one zero
        order = np.lexsort((ids, *matrix.T[::-1]))
        ids, matrix = ids[order], matrix[order]
        new = np.r_[True, (matrix[1:] != matrix[:-1]).any(axis=1)]
        self.ids, self.keys = ids, keys[order]
        self.starts = np.r_[np.flatnonzero(new), len(ids)]
        self.exact = matrix[new]
        # a power of two changes no digit; squares then neither overflow nor vanish
        _, power = np.frexp(np.abs(self.exact).max(axis=1))
        scaled = np.ldexp(self.exact, -power[:, None])
        self.squares = (scaled * scaled).sum(axis=1)
        self.scaled = scaled
        unit = scaled / np.sqrt(self.squares)[:, None]
        self.step = np.abs(unit).max(axis=1) / 127
        self.int8 = np.rint(unit / self.step[:, None]).astype(np.int8)
        rounded = self.int8 * self.step[:, None]
        self.error = np.sqrt(((unit - rounded) ** 2).sum(axis=1)) + SLACK
        self.size = np.sqrt((rounded * rounded).sum(axis=1)) + SLACK

    def __len__(self) -> int:
        return len(self.exact)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of two int8 matrices, exact."""
    total = np.zeros((len(a), len(b)))
    for start in range(0, a.shape[1], EXACT_COMPONENTS):
        part = slice(start, start + EXACT_COMPONENTS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def cosines(a: Slice, i: np.ndarray, b: Slice, j: np.ndarray) -> np.ndarray:
    """The cosines of pairs in double precision; the same for equal vectors wherever they lie."""
    out = np.empty(len(i))
    step = max(1, (8 << 20) // (8 * a.scaled.shape[1]))
    for start in range(0, len(i), step):
        x, y = i[start : start + step], j[start : start + step]
        out[start : start + step] = (a.scaled[x] * b.scaled[y]).sum(axis=1) / np.sqrt(a.squares[x] * b.squares[y])
    return out


def nearest_in_tile(queries: Slice, candidates: Slice, k: int) -> list[list[tuple[float, int]]]:
    """Per different query vector a heap of the k + 1 best (score, minus id)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
    keep = k + 1
    floor = np.full(len(queries), -np.inf)
    for left in range(0, len(candidates), CANDIDATE_STEP):
        c = slice(left, left + CANDIDATE_STEP)
        for top in range(0, len(queries), QUERY_STEP):
            q = slice(top, top + QUERY_STEP)
            near = products(queries.int8[q], candidates.int8[c])
            near *= queries.step[q, None]
            near *= candidates.step[None, c]
            error = queries.error[q, None] + queries.size[q, None] * candidates.error[None, c]
            if near.shape[1] >= keep:
                own = -np.partition(error - near, keep - 1, axis=1)[:, keep - 1]
                floor[q] = np.maximum(floor[q], own)
            i, j = np.nonzero(near + error >= floor[q, None])
            scores = cosines(queries, i + top, candidates, j + left)
            for query, other, score in zip((i + top).tolist(), (j + left).tolist(), scores.tolist()):
                heap = heaps[query]
                first, end = candidates.starts[other], candidates.starts[other + 1]
                for number in candidates.ids[first : min(end, first + keep)].tolist():
                    entry = (score, -number)
                    if len(heap) < keep:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    else:
                        break
            for query in set((i + top).tolist()):
                if len(heaps[query]) == keep:
                    floor[query] = max(floor[query], heaps[query][0][0] - SLACK)
    return heaps


def _tile(k: int) -> Callable:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in _FOUND.names}
        others = dict(_by_length(candidates))
        for length, asked in _by_length(queries):
            if length not in others:
                continue
            same = _scores_of_equals(asked, others[length])
            for query, heap in enumerate(nearest_in_tile(asked, others[length], k)):
                best = sorted(heap, reverse=True)
                for row in range(asked.starts[query], asked.starts[query + 1]):
                    number = int(asked.ids[row])
                    left = list(best)
                    if (same[query], -number) in left:  # the query's own row
                        left.remove((same[query], -number))
                    found["query_id"].append(number)
                    found["query_key"].append(int(asked.keys[row]))
                    found["ids"].append([-i for _, i in left[:k]])
                    found["scores"].append([score for score, _ in left[:k]])
        return pa.Table.from_pydict(found, _FOUND)

    return run


_FOUND = pa.schema(
    [("query_id", pa.int64()), ("query_key", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]
)


def _scores_of_equals(asked: Slice, given: Slice) -> list[float | None]:
    """Per query vector its score with the equal candidate; none where there is none."""
    places = {row.tobytes(): i for i, row in enumerate(given.exact)}
    at = np.array([places.get(row.tobytes(), -1) for row in asked.exact], np.int64)
    found = np.flatnonzero(at >= 0)
    scores: list[float | None] = [None] * len(asked)
    for query, score in zip(found.tolist(), cosines(asked, found, given, at[found]).tolist()):
        scores[query] = score
    return scores


def _merge(k: int) -> Callable:
    """One heap per query over its rows, which follow each other."""

    def ranked(query: int, heap: list[tuple[float, int]], out: dict[str, list]) -> None:
        for rank, (score, number) in enumerate(sorted(heap, reverse=True), 1):
            out["query_id"].append(query)
            out["rank"].append(rank)
            out["vec_id"].append(-number)
            out["score"].append(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "rank": [], "vec_id": [], "score": []}
            for query, key, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("query_id", "query_key", "ids", "scores"))):
                if (query, key) != now:
                    if now is not None:
                        ranked(now[0], heap, out)
                    now, heap = (query, key), []
                for entry in zip(scores, (-i for i in ids)):
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            yield pa.RecordBatch.from_pydict(out, _RESULT)
        if now is not None:
            out = {"query_id": [], "rank": [], "vec_id": [], "score": []}
            ranked(now[0], heap, out)
            yield pa.RecordBatch.from_pydict(out, _RESULT)

    return run


_RESULT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _slices(rows: int, components: int, tasks: int) -> int:
    by_bytes = -(-4 * components // SLICE_BYTES)
    return max(1, by_bytes, min(tasks, rows // LEAST_ROWS))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine to every row for which `is_query` holds."""
    spark = vectors.sparkSession
    chosen = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    rows = chosen.where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("id", "vector").agg(F.max("asked").alias("asked"))
    rows = written(rows.withColumn("key", F.xxhash64("id", "vector")), "vectors")
    counts = rows.agg(
        F.count("*"), F.sum(F.size("vector")), F.count_if("asked"), F.sum(F.when(F.col("asked"), F.size("vector")))
    ).first()
    n, total, n_asked, total_asked = (x or 0 for x in counts)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidate_slices, query_slices = _slices(n, total, tasks), _slices(n_asked, total_asked, 1)

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(1)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    queries = rows.where("asked").select("id", "vector", "key", dealt(query_slices).alias("q"), every(candidate_slices).alias("c"))
    candidates = rows.select("id", "vector", "key", dealt(candidate_slices).alias("c"), every(query_slices).alias("q"))
    tiles = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(_tile(k), FOUND)
    lined_up = tiles.repartition("query_id", "query_key").sortWithinPartitions("query_id", "query_key")
    return lined_up.mapInArrow(_merge(k), RESULT)
