"""Runs: stretches of consecutive words that repeat with a smallest period q at least four times (length >= max(6, 4q)) and that no neighbouring word extends.

An online sparse diagonal DP over each text. Reading the words in order, an earlier occurrence of a word at distance q stands on diagonal q; a diagonal's length counts the
matches in a row on it, and when a word fails to match, the diagonal ends and is emitted at once as a run if it is long enough and no divisor of q is a period too.

Sparse, without losing a run:
* A run's diagonal has at least max(6, 4q) - q matches, so 5 or more in a row. An occurrence counts only if the next four words match as well; texts in which no five
  words stand twice are done after one sort of hashes for many texts together (hashes only select, matches are compared by word).
* The diagonal of a run of period q in [2^k, 2^(k+1)) has more than 2^k such matches in a row, so one of them begins at a multiple of 2^k: only there are
  occurrences at these distances looked up, at most 2^k each, and n log n for a text of n words, be they all the same.
* A diagonal is followed once: its end is kept, and occurrences before it are skipped. Multiples of a period inside its run are skipped without a look.

Each text is a row's own work (no shuffle); memory is in proportion to PIECE_CHARS and the longest text.

Cases: a null or empty text, or one of white space only, has no words, no runs and an empty collapsed text; repeated rows and ids are handled row by row; equal words are
equal bytes (no case folding); with `planted`, a null doc_id plants nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces

#: Words that every diagonal of a run matches in a row, at least.
GRAM = 5
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For every tenth document, by the crc32 of its id: from some word on, the text is a stretch repeated over and over."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _smallest(ids: list[int], start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the stretch from `start`, which has period q and more than twice its length."""
    rest, f = q, 2
    primes = set()
    while f * f <= rest:
        while rest % f == 0:
            primes.add(f)
            rest //= f
        f += 1
    if rest > 1:
        primes.add(rest)
    return all(ids[start : start + q] != ids[start + q // f : start + q // f + q] for f in primes)


def find_runs(ids: list[int], live: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `ids`, by start, then period. `live`: (position, key) in order, of positions whose GRAM ids may stand elsewhere too, with a key that equal ones share."""
    n = len(ids)
    before: dict[int, list[int]] = defaultdict(list)
    ended: dict[int, int] = {}  # of each diagonal, the position after the last match that was followed
    runs: list[tuple[int, int, int]] = []
    inside: list[tuple[int, int, int]] = []  # start, end, period of emitted runs that may reach on
    for i, key in live:
        seen = before[key]
        if seen:
            inside = [r for r in inside if r[1] > i]
            step = 1
            while i % step == 0 and step <= n // 4:
                for at in range(bisect_right(seen, i - step) - 1, bisect_left(seen, i - 2 * step + 1) - 1, -1):
                    q = i - seen[at]
                    if 4 * q > n or ended.get(q, 0) > i or any(q % r == 0 and s <= i - q for s, _, r in inside):
                        continue
                    first, end = i, i
                    while first > q and ids[first - 1] == ids[first - 1 - q]:
                        first -= 1
                    while end < n and ids[end] == ids[end - q]:
                        end += 1
                    ended[q] = end
                    start = first - q
                    if end - start >= max(6, 4 * q) and _smallest(ids, start, q):
                        runs.append((start, end - start, q))
                        inside.append((start, end, q))
                step *= 2
        seen.append(i)
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def _live(texts: list[list[int]]) -> dict[int, list[tuple[int, int]]]:
    """Of each text with GRAM words that stand in it twice: where such words stand, with their hashes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(chain.from_iterable(texts), np.uint64, int(lengths.sum()))
    if len(ids) < GRAM:
        return {}
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    h = mix64(of[: len(ids) - GRAM + 1] + np.uint64(1))
    for i in range(GRAM):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - GRAM + 1 + i])
    at = np.flatnonzero(of[: len(h)] == of[GRAM - 1 :])
    h = h[at]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.cumsum(lengths) - lengths
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    at, h = at[twice], h[twice]
    docs = of[at].astype(np.int64)
    for doc, place, key in zip(docs.tolist(), (at - starts[docs]).tolist(), h.tolist(), strict=True):
        out[doc].append((place, key))
    return out


def _scan(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches):
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        del texts
        if planted:
            words = [planted_tail(i, w) for i, w in zip(part.column("doc_id").to_pylist(), words, strict=True)]
        number = defaultdict(count().__next__)
        ids = [list(map(number.__getitem__, w)) for w in words]
        runs = [[] for _ in words]
        for doc, live in _live(ids).items():
            runs[doc] = find_runs(ids[doc], live)
        shown = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        left = [b" ".join(collapsed_words(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
        columns = [part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(shown, pa.list_(_RUN)), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def scan(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed (the words outside repetitions, joined by one space) of each row of `docs` (doc_id, text).

    `planted`: on texts with periodic tails put in by `planted_tail`, so that runs of every length are there to be found.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, planted), f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and its exponent in thousandths, SHA-256 of the list of runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = scanned.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return shown.select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.shorter) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
