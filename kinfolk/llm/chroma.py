"""Chroma audio fingerprints of a media column, and the alignment of recordings.

Sound becomes frames of twelve pitch classes (short Fourier transforms folded by octave), frames become an integral image, and each window of
frames becomes one 32-bit integer: sixteen rectangle filters, compared by their areas' log ratio and cut to two bits each (Gray code).
Recordings align at the offset on which most integers agree; the bit errors of all overlapping integers at that offset tell whether they are alike.

Queries are broadcast in slices of bounded size and met by every row where it lies; no pairs are shuffled but those that align.

Cases: null, empty or too short sound has no fingerprint and aligns with nothing; silence has equal integers throughout, and offsets that tie go to the smallest
shift, then the negative one; a row is not aligned with its own id; null ids are left out; repeated ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

RATE, FRAME, HOP, WIDTH = 4000, 1024, 256, 16
SLICE = 2048
#: Filters: kind (0 upper and lower half, 1 left and right half, 2 middle and outer thirds of time), first pitch class, classes, frames; then the cuts of the log ratio.
FILTERS = [(k, c, h, w) for k, w in ((0, 4), (0, 16), (1, 8), (1, 16), (2, 12)) for c, h in ((0, 4), (4, 4), (8, 4))] + [(1, 0, 12, 16)]
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """(frequency bins, 12): which pitch class each bin adds to."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    some = (f >= 55) & (f <= 1760)
    out[np.flatnonzero(some), np.round(12 * np.log2(f[some] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12): the energy of each pitch class, each frame's sum 1 (0 in silence)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ _fold()
    total = energy.sum(axis=1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One uint32 for each window of WIDTH frames."""
    frames = chroma(samples)
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        if kind == 0:
            x, y = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h)
        elif kind == 1:
            x, y = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        else:
            x, y = area(w // 3, 2 * w // 3, c, c + h), area(0, w, c, c + h) - area(w // 3, 2 * w // 3, c, c + h)
        ratio = np.log((np.maximum(x, 0) + 0.01) / (np.maximum(y, 0) + 0.01))
        out = out << np.uint32(2) | GRAY[np.searchsorted(CUTS, ratio)]
    return out


def fingerprints(media: DataFrame, key: str = "vec_id", sound: str = "pcm") -> DataFrame:
    """key, fingerprint (its integers, little-endian) of each row's 16-bit mono sound."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(np.frombuffer(x or b"", "<i2", len(x or b"") // 2).astype(np.float32)).astype("<u4").tobytes() for x in batch.column(sound).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.binary())], [key, "fingerprint"])

    return media.select(key, sound).mapInArrow(printed, f"{key} long, fingerprint binary")


def align(prints: DataFrame, queries: DataFrame, key: str = "vec_id", least_votes: int = 4, most_errors: float = 0.3) -> DataFrame:
    """query_id, key, shift (query place minus row place), votes, bit_error of the rows that align with a query."""
    spark = prints.sparkSession
    asked = save(queries.where(f"{key} is not null and length(fingerprint) > 0"))
    slices = max(1, -(-asked.count() // SLICE))
    parts = []
    for s in range(slices):
        held = sorted((r[key], bytes(r.fingerprint)) for r in asked.where(F.pmod(F.xxhash64(key), F.lit(slices)) == s).collect())
        shared = spark.sparkContext.broadcast(held)

        def aligned(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sounds = [np.frombuffer(x, "<u4") for _, x in shared.value]
            values = np.concatenate([*sounds, np.zeros(0, np.uint32)])
            owner = np.repeat(np.arange(len(sounds)), [len(x) for x in sounds])
            place = np.concatenate([*(np.arange(len(x)) for x in sounds), np.zeros(0, np.int64)]).astype(np.int64)
            order = np.argsort(values, kind="stable")
            values, owner, place = values[order], owner[order], place[order]
            for batch in batches:
                rows = []
                for row_id, x in zip(batch.column(key).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                    own = np.frombuffer(x or b"", "<u4")
                    lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                    n = hi - lo
                    if row_id is None or not n.sum():
                        continue
                    hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    shift = place[hit] - np.repeat(np.arange(len(own)), n)
                    cells, votes = np.unique(owner[hit] * (1 << 32) + shift + (1 << 31), return_counts=True)
                    cells, votes = cells[votes >= least_votes], votes[votes >= least_votes]
                    q, shift = cells >> 32, (cells & ((1 << 32) - 1)) - (1 << 31)
                    best = np.lexsort((shift, np.abs(shift), -votes, q))
                    for at in best[np.concatenate([[True], q[best][1:] != q[best][:-1]])] if len(best) else ():
                        a, d = sounds[q[at]], int(shift[at])
                        start, end = max(0, -d), min(len(own), len(a) - d)
                        errors = float(np.bitwise_count(own[start:end] ^ a[start + d : end + d]).sum()) / (32 * (end - start))
                        if errors <= most_errors and shared.value[q[at]][0] != row_id:
                            rows.append((shared.value[q[at]][0], row_id, d, int(votes[at]), errors))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", key, "shift", "votes", "bit_error"])

        parts.append(prints.mapInArrow(aligned, f"query_id long, {key} long, shift long, votes long, bit_error double"))
    union = parts[0]
    for more in parts[1:]:
        union = union.union(more)
    return union


def sonified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of each row of `embeddings`, as the tables hold none: each component is a note of 64 ms, higher for larger values (vec_id, pcm)."""

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(HOP) / RATE
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_pylist():
                notes = np.nan_to_num(np.array([0.0 if v is None else v for v in x or []], float), posinf=0, neginf=0)
                pitch = 220 * 2 ** (np.clip(np.round(notes * 24), -24, 24) / 12)
                out.append((8000 * np.sin(2 * np.pi * pitch[:, None] * t)).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "pcm"])

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return rows.mapInArrow(sound, "vec_id long, pcm binary")
