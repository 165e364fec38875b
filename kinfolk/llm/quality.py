"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the sum-of-squares identity makes a text's score linear in its words.
It is fitted on the driver by mini-batch AdaGrad, on at most `max_rows` labelled documents (those with the smallest hashes of their ids);
everything else, the scoring included, is done by executors on whole texts.

Cases: a null or empty text is scored from zero statistics; without labelled rows every score is 0.5; a null label is left out; a null doc_id counts as
held out; repeated labels are used as they come; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, mix64, pieces, word_hashes

WORD_BITS = 14
STATS = ("chars", "words", "word_length", "upper", "digit", "symbol", "other", "spaces", "distinct", "repeats", "top", "line_repeats", "capital_words", "odd_ends")
#: Classes of bytes: 0 lower-case letters and bytes beyond ASCII, 1 upper case, 2 digits, 3 symbols, 4 plain punctuation, 5 white space.
CLASS = np.zeros(256, np.uint8)
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        CLASS[_c] = 4 if chr(_c) in ".,;:'\"-()?" else 3
CLASS[[9, 10, 11, 12, 13, 32]] = 5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (row, bucket, value), each row of length 1, and the statistics of each text."""
    hashes, bounds = word_hashes(texts)
    buckets = (mix64(hashes) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), lengths)
    cells, counts = np.unique(owner << WORD_BITS | buckets, return_counts=True)
    row, bucket, value = cells >> WORD_BITS, cells & ((1 << WORD_BITS) - 1), np.sqrt(counts.astype(np.float64))
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    value /= norm[row] if len(row) else 1
    stats = np.zeros((len(texts), len(STATS)))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(raw):
            continue
        kinds = CLASS[raw]
        share = np.bincount(kinds, minlength=6) / len(raw)
        a, b = bounds[i], bounds[i + 1]
        n = b - a
        distinct, often = np.unique(hashes[a:b], return_counts=True)
        lines = [x for x in text.split("\n") if x]
        starts = np.flatnonzero((kinds != 5) & (np.concatenate([[5], kinds[:-1]]) == 5))
        ends = np.flatnonzero((kinds != 5) & (np.concatenate([kinds[1:], [5]]) == 5))
        stats[i] = [
            np.log1p(len(text)), np.log1p(n), len(raw) / max(1, n), share[1], share[2], share[3], share[4], share[5],
            len(distinct) / max(1, n), same[a:b].mean() if n else 0, often.max() / n if n else 0, 1 - len(set(lines)) / max(1, len(lines)),
            (kinds[starts] == 1).mean() if len(starts) else 0, (kinds[ends] == 3).mean() if len(ends) else 0,
        ]
    return row, bucket, value, stats


class FactorisationMachine:
    """Columns: the word buckets, then the standardised statistics."""

    def __init__(self, rank: int = 8, seed: int = 7):
        size = (1 << WORD_BITS) + len(STATS)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def cells(self, row, bucket, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(stats)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
        columns = np.concatenate([bucket, np.tile(np.arange(len(STATS)) + (1 << WORD_BITS), n)])
        return rows, columns, np.concatenate([value, z.ravel()])

    def logits(self, n: int, rows, columns, x) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums over v x of each row, by the sum-of-squares identity."""
        vx = self.v[columns] * x[:, None]
        sums, squares = (np.stack([np.bincount(rows, a[:, f], n) for f in range(a.shape[1])], axis=1) for a in (vx, vx**2))
        return self.w0 + np.bincount(rows, self.w[columns] * x, n) + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def scores(self, texts: list[str]) -> np.ndarray:
        row, bucket, value, stats = features(texts)
        raw, _ = self.logits(len(texts), *self.cells(row, bucket, value, stats))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 256, rate: float = 0.15, l2: float = 1e-4) -> FactorisationMachine:
        """docs: (buckets, values, statistics, label) of each."""
        stats = np.stack([d[2] for d in docs])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        y = np.array([d[3] for d in docs], float)
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        g0, gw, gv = 1.0, np.ones_like(self.w), np.ones_like(self.v)
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(docs), batch):
                some = order[a : a + batch]
                row = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
                cells = self.cells(row, np.concatenate([docs[i][0] for i in some]), np.concatenate([docs[i][1] for i in some]), stats[some])
                raw, sums = self.logits(len(some), *cells)
                rows, columns, x = cells
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some) * 16
                hit, place = np.unique(columns, return_inverse=True)
                dw = np.bincount(place, error[rows] * x) + l2 * self.w[hit]
                per_cell = (error[rows] * x)[:, None] * (sums[rows] - self.v[columns] * x[:, None])
                dv = np.stack([np.bincount(place, per_cell[:, f]) for f in range(self.v.shape[1])], axis=1) + l2 * self.v[hit]
                g0 += error.sum() ** 2
                gw[hit] += dw**2
                gv[hit] += dv**2
                self.w0 -= rate * error.sum() / np.sqrt(g0)
                self.w[hit] -= rate * dw / np.sqrt(gw[hit])
                self.v[hit] -= rate * dv / np.sqrt(gv[hit])
        return self


def training_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, label of at most `max_rows` labelled rows outside the held-out fold, those with the smallest hashes of their ids."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, rank: int = 8) -> FactorisationMachine | None:
    """The model, from at most `max_rows` labelled documents; None if there are none. The sample is broadcast: `max_rows` bounds it."""
    sample = docs.select("doc_id", "text").join(F.broadcast(training_sample(labels, "quality", max_rows)), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            row, bucket, value, stats = features(texts)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            arrays = [pa.array([a[ends[i] : ends[i + 1]].tobytes() for i in range(len(texts))], pa.binary()) for a in (bucket.astype("<i4"), value.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *arrays, pa.array([s.tobytes() for s in stats], pa.binary())], ["doc_id", "label", "buckets", "values", "stats"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(featured, "doc_id long, label int, buckets binary, values binary, stats binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.buckets)))
    return FactorisationMachine(rank).fit([(np.frombuffer(r.buckets, "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(np.float64), np.frombuffer(r.stats), r.label) for r in rows])


def score(docs: DataFrame, model: FactorisationMachine | None, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            scores = shared.value.scores(texts) if shared.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: FactorisationMachine | None, least: float = 0.3) -> DataFrame:
    """The documents that the model does not reject, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield part.filter(pa.array(shared.value.scores(texts) >= least)) if shared.value else part

    return docs.mapInArrow(kept, docs.schema)
