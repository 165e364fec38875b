"""Exact top-k by inner product, by no-random-access aggregation over sorted lists.

Candidates are searched where they lie, in blocks of `block` rows; each block keeps one sorted list per component. For a query the lists are read
in step, downwards where its weight is positive and upwards where it is negative. What is read of a candidate, and the last value read of the lists where
it has not come up, give it a lower and an upper bound; candidates whose upper bound is below the k-th best lower bound, or below the query's k-th best
score so far, are out. A block whose list heads already cannot reach that is not read at all. When few are left, they get their scores; otherwise the
lists are read on to the end, where both bounds are the score. All queries of a batch read together: their bounds are matrix products. How deep it pays to
read first is learned from block to block: where bounds put hardly anyone out, the lists are read to the end at once.

Queries are broadcast in slices of bounded size, one pass over the candidates a slice; a slice's results are written before the next is read.

Cases: vectors that are null, or hold a null or non-finite component, take no part; ties go to the smaller vec_id; a query's own row (its vec_id) is no candidate;
repeated vec_ids are rows of their own; vectors of another length than the query are no candidates; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SLICE, BATCH = 8192, 256
#: The score of what has none.
NONE = np.iinfo(np.int64).min
#: Shares of the lists that are read before the bounds are looked at, and the share of candidates that must be out for reading on to pay.
DEPTHS, PAYS = (0.5, 0.75), 0.5


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component, of the vectors that take part."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


class Block:
    """Candidates (ids, rows of whole numbers held as doubles) with a sorted list of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lists = np.sort(rows, axis=0)
        self.read_to: dict[float, tuple[np.ndarray, ...]] = {}

    def fronts(self, depth: float) -> tuple[np.ndarray, ...]:
        """For lists read downwards and upwards to the share `depth`: what each component of a candidate is at most and at least."""
        if depth not in self.read_to:
            n, rows, (low, high) = len(self.rows), self.rows, self.lists[[0, -1]]
            read = min(n - 1, int(depth * n))
            top, bottom = self.lists[n - 1 - read], self.lists[read]
            down, up = rows >= top, rows <= bottom
            self.read_to[depth] = np.where(down, rows, top).T, np.where(up, rows, bottom).T, np.where(down, rows, low).T, np.where(up, rows, high).T
        return self.read_to[depth]


class Reader:
    """Reads blocks for a batch of queries; keeps each query's k best so far (scores and ids, best first) and what reading has cost."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        self.scores = np.full((len(queries), k), NONE)
        self.found = np.zeros((len(queries), k), np.int64)
        self.first = 0
        #: pairs of query and candidate met, and those whose lists were read to the end or that got their score by themselves
        self.met = self.resolved = 0

    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def read(self, block: Block) -> None:
        """Candidates with a score equal to the k-th best stay in: their ids may be smaller."""
        floor, n = self.floor(), len(block.ids)
        low, high = block.lists[[0, -1]]
        some = np.flatnonzero(self.up.astype(high.dtype) @ high + self.down.astype(high.dtype) @ low >= floor)
        self.met += n * len(self.queries)
        alive = None
        own = self.query_ids[some, None] == block.ids
        for depth in DEPTHS[self.first :] if len(some) else ():
            most_down, most_up, least_down, least_up = block.fronts(depth)
            up, down, at_least = self.up[some].astype(high.dtype), self.down[some].astype(high.dtype), floor[some]
            upper = up @ most_down + down @ most_up
            if n >= self.k and (at_least == NONE).any():  # else the k-th best so far serves
                lower = (up @ least_down + down @ least_up).astype(np.int64)
                lower[own] = NONE
                at_least = np.maximum(at_least, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
            alive = (upper >= at_least[:, None]) & ~own
            if alive.mean() <= 1 - PAYS:
                break
            self.first += not (floor[some] == NONE).any()  # this depth does not pay here
            alive = None
        if not len(some):
            return
        if alive is None:
            scores = (self.queries[some].astype(block.rows.dtype) @ block.rows.T).astype(np.int64)
            scores[own] = NONE
            self.resolved += scores.size
        else:
            scores = np.full((len(some), n), NONE)
            for i in range(len(some)):
                at = np.flatnonzero(alive[i])
                scores[i, at] = block.rows[at] @ self.queries[some[i]].astype(block.rows.dtype)
                self.resolved += len(at)
        self._keep(some, scores, block.ids)

    def _keep(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k, n = self.k, scores.shape[1]
        kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), NONE)
        most = scores.max(axis=1)
        for i in np.flatnonzero((most >= self.scores[some, -1]) & (most > NONE)):
            q = some[i]
            at = np.flatnonzero((scores[i] >= max(kth[i], self.scores[q, -1])) & (scores[i] > NONE))
            x, of = np.concatenate([self.scores[q], scores[i, at]]), np.concatenate([self.found[q], ids[at]])
            best = np.lexsort((of, ~x))[:k]  # ~x falls as x rises, without a whole number that has no negative
            self.scores[q], self.found[q] = x[best], of[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for each of `queries` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    candidates, asked = quantized(vectors, scale), save(quantized(queries, scale))
    slices = max(1, -(-asked.count() // SLICE))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for s in range(slices):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).toArrow()
        shared = spark.sparkContext.broadcast((held.column("vec_id").to_numpy(), *lists(held.column("q").combine_chunks())))

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, flat, ends = shared.value
            sizes = np.diff(ends, prepend=0)
            readers: dict[int, list[Reader]] = {}
            waiting: dict[int, tuple[list, list]] = {}

            def look(ids: list[np.ndarray], rows: list[np.ndarray]) -> None:
                ids_, rows_ = np.concatenate(ids), np.concatenate(rows)
                m = rows_.shape[1]
                if m not in readers:
                    of = np.flatnonzero(sizes == m)
                    asked_ = flat[(ends[of] - m)[:, None] + np.arange(m)]
                    readers[m] = [Reader(query_ids[of[a : a + BATCH]], asked_[a : a + BATCH], k) for a in range(0, len(of), BATCH)]
                plain: Block | None = None
                for reader in readers[m]:
                    # doubles are exact below 2 ** 53; beyond, whole numbers
                    exact = int(np.abs(rows_).max(initial=1)) * int(np.abs(reader.queries).max(initial=1)) * max(1, m) < 1 << 52
                    kind = np.float64 if exact else np.int64
                    if plain is None or plain.rows.dtype != kind:
                        plain = Block(ids_, rows_.astype(kind))
                    reader.read(plain)

            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                values, stops = lists(batch.column("q"))
                own = np.diff(stops, prepend=0)
                for size in np.unique(own):
                    some = np.flatnonzero(own == size)
                    rows = values[(stops[some] - size)[:, None] + np.arange(size)]
                    kept = waiting.setdefault(int(size), ([], []))
                    for a in range(0, len(some), block):
                        kept[0].append(ids[some[a : a + block]])
                        kept[1].append(rows[a : a + block])
                        if sum(map(len, kept[0])) >= block:
                            look(*kept)
                            kept[0].clear()
                            kept[1].clear()
            for kept in waiting.values():
                if kept[0]:
                    look(*kept)
            for reader in (r for rs in readers.values() for r in rs):
                q, at = np.nonzero(reader.scores > NONE)
                columns = reader.query_ids[q], reader.found[q, at], reader.scores[q, at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

        best = candidates.mapInArrow(searched, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        parts.append(best if slices == 1 else save(best))
        if slices > 1:
            shared.unpersist()
    return reduce(DataFrame.union, parts)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists end to end, and where each list ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets[1:] - offsets[0]
