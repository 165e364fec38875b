"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated scores.

The index holds every word of the examples, a bounded sample of labelled documents; document counts for the IDF come from all documents. A word weighs
its IDF times `FLOOR` plus the part of its log odds among toxic examples that stands beyond chance, so that words which mark toxic texts count most and no word of
an example is left out. Examples stand in blocks of BLOCK, like beside like. Words that many examples hold are kept as whole columns, multiplied for many queries at once; for
every other word and block the largest weight is kept (for words in many of the blocks as rows of a matrix, for the rest as lists), and a query skips the blocks whose bound (the block's best sum over the columns, and the largest weights) is
below its k-th best score; where that leaves many blocks, it reads its lists whole.

Cases: words that no example holds have no weight; texts of such words only (null and empty ones too) have no neighbours and get the calibrated rate of such texts;
without labelled rows of both kinds every score is 0; ties go to the smaller doc_id; null labels are left out, and of several labels of one id the toxic one counts; of
several labelled texts of one id the smallest is the example; a null doc_id counts as held out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Frames, fold_of, pieces, shuffle_partitions

WORD = re.compile(r"[^\W\d_]+")
#: Hashes of words with equal bits from here on stand together.
LEADING = np.uint64(44)
#: In UTF-8: ASCII letters and all that is not ASCII stay, the rest becomes blanks.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
BLOCK = 64
#: Blocks read in a query's first round, best bounds first; each later round reads four times as many.
AT_ONCE = 6
#: If one in so many blocks or more may still hold a neighbour after the first round, the query's lists are read whole, which costs less than to pick blocks from them.
WHOLE = 6
#: Words that more than one in so many examples holds are columns.
COLUMN = 16
#: Words in at least one in so many blocks are rows.
ROW = 4
#: Queries multiplied at once.
QUERIES = 64
#: What a word weighs without any bearing on toxicity, and the standard errors taken off its log odds: the best of eight pairs by AUC over three folds of the training rows of sf0.1.
FLOOR, ERRORS = 0.3, 2.0
REMEMBERED = 20_000


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Numbers:
    """The numbers of words (in UTF-8, with blanks between), by their 64-bit hashes, sorted: many words are looked up at once. Only the words travel, as hashes differ between processes."""

    def __init__(self, words: bytes):
        self.words = words
        hashes = self.hashes(words.split())
        order = np.argsort(hashes)
        self.keys, self.order = hashes[order], order.astype(np.int32)
        self.begins = np.searchsorted(self.keys >> LEADING, np.arange((1 << 64 - int(LEADING)) + 1, dtype=np.uint64)).astype(np.int32)

    def __reduce__(self):
        return Numbers, (self.words,)

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, word: bytes) -> bool:
        return self.of([word])[0] >= 0

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Each one's number, or -1."""
        hashes, out = self.hashes(words), np.full(len(words), -1, np.int64)
        lead = (hashes >> LEADING).astype(np.int64)
        at, end = self.begins[lead], self.begins[lead + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == hashes[left]
            out[left[hit]] = self.order[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def numbered(words: list[str]) -> Numbers:
    return Numbers(" ".join(words).encode())


def counted(texts: list[str], number: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text holds which known term how often, by text and term. Cut at ASCII first, which is fast; pieces that are no known word and not ASCII may hold several terms."""
    found, lengths = [], []
    for text in texts:
        words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
        found += words
        lengths.append(len(words))
    owner, term = np.repeat(np.arange(len(texts)), lengths), number.of(found)
    rest = [i for i in np.flatnonzero(term < 0).tolist() if not found[i].isascii()]
    if rest:
        parts = [[w.encode("utf-8", "surrogatepass") for w in terms(found[i].decode("utf-8", "surrogatepass"))] for i in rest]
        owner = np.concatenate([owner, np.repeat(owner[rest], [len(p) for p in parts])])
        term = np.concatenate([term, number.of([w for p in parts for w in p])])
    cell = np.sort(owner[term >= 0] * len(number) + term[term >= 0])
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[first] // max(1, len(number)), cell[first] % max(1, len(number)), np.diff(np.append(first, len(cell)))


def known(text: str, number: Numbers) -> list[int]:
    """The numbers of all its terms that have one."""
    _, term, tf = counted([text], number)
    return np.repeat(term, tf).tolist()


def term_weights(df: np.ndarray, documents: int, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """IDF over all documents times FLOOR plus the lower bound of a word's log odds, from the toxic and clean examples that hold it."""
    idf = np.log((1 + documents) / (1 + df)) + 1
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.maximum(idf, 1e-3) * (FLOOR + np.maximum(0, odds - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    out = np.arange(lengths.sum())
    out += np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    return out


def arranged(owner: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, n_terms: int, width: int = 32) -> np.ndarray:
    """An order of the examples with like ones beside each other: halves along the main direction of random projections, down to one block."""
    rng = np.random.default_rng(0)
    sketch = np.stack([np.bincount(owner, x * rng.standard_normal(n_terms)[term], n) for _ in range(width)], 1)
    out, open_ = [], [np.arange(n)]
    while open_:
        rows = open_.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        centred = sketch[rows] - sketch[rows].mean(0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        rows = rows[np.argsort(along, kind="stable")]
        half = BLOCK * (-(-len(rows) // BLOCK) // 2)
        open_ += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Scale:
    """From shares of toxic votes to scores: pool-adjacent-violators over the shares, the plain rate for texts without neighbours."""

    def __init__(self, votes: list[tuple[float | None, int, float]]):
        """votes: (share or None, label, weight of the row)."""
        none = [(y, w) for v, y, w in votes if v is None]
        self.alone = (sum(y * w for y, w in none)) / (sum(w for _, w in none) + 1) if none else 0.0
        pools: list[list[float]] = []
        for v, y, w in sorted(x for x in votes if x[0] is not None):
            pools.append([v * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.shares = np.array([p[0] / p[2] for p in pools] or [0.0])
        self.rates = np.maximum.accumulate([(p[1] + 0.5 * self.alone) / (p[2] + 0.5) for p in pools] or [0.0])

    def score(self, share: float | None) -> float:
        """Calibrated, and strictly rising a little with the share, so that ties of the calibration keep their order."""
        if share is None:
            return min(1.0, self.alone)
        return min(1.0, 0.999 * float(np.interp(share, self.shares, self.rates)) + 0.001 * share)


class Index:
    """Unit vectors of the examples in an inverted index with block maxima. Only what it is made from travels: each worker builds the rest."""

    def __init__(self, number: Numbers, weight: np.ndarray, doc_ids: np.ndarray, labels: np.ndarray, holders: np.ndarray, docs: np.ndarray, tf: np.ndarray):
        """holders: how many examples hold each word; docs, tf: their places, word by word and rising, and how often each holds it."""
        self.number, self.weight, self.doc_ids, self.labels = number, weight, doc_ids, labels.astype(float)
        self.source = number, weight, doc_ids, labels, holders, docs, tf
        n, at = len(doc_ids), docs.astype(np.int32)
        self.blocks = max(1, -(-n // BLOCK))
        x = (1 + np.log(tf)) * np.repeat(weight, holders)
        x /= np.sqrt(np.bincount(at, x * x, n))[at]
        common = holders * COLUMN > n
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.columns = np.zeros((int(common.sum()), self.blocks * BLOCK))
        column = np.repeat(self.column, holders)
        self.columns[column[column >= 0], at[column >= 0]] = x[column >= 0]
        self.docs, self.x = at[column < 0].astype(np.int64), x[column < 0]
        cell = np.repeat(np.arange(len(number)), np.where(common, 0, holders)) * self.blocks + self.docs // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        maxima = np.maximum.reduceat(self.x, first) if len(first) else np.zeros(0)
        of, block, starts = cell[first] // self.blocks, (cell[first] % self.blocks).astype(np.int32), np.append(first, len(cell)).astype(np.int32)
        many = np.bincount(of, minlength=len(number)) * ROW >= self.blocks
        #: rows: the largest weight in each block, and where the postings of each begin
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.tallest = np.zeros((int(many.sum()), self.blocks))
        self.tallest[self.row[of[many[of]]], block[many[of]]] = maxima[many[of]]
        self.begins = np.searchsorted(cell, np.flatnonzero(many)[:, None] * self.blocks + np.arange(self.blocks + 1)).astype(np.int32)
        self.lists = np.append(0, np.cumsum(np.where(common, 0, holders))).astype(np.int32)
        #: an entry: the postings of one other word in one block
        few = ~many[of]
        self.maxima, self.block, self.starts, self.stops = maxima[few], block[few], starts[:-1][few], starts[1:][few]
        self.entries = np.searchsorted(of[few], np.arange(len(number) + 1)).astype(np.int32)
        self.remembered: dict[int, tuple[float | None, list[int]]] = {}
        self.broadcast, self.scale = None, Scale([])

    @classmethod
    def of(cls, words: list[str] | Numbers, weight: np.ndarray, doc_ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Index:
        """words: as strings without blanks, or their numbers; owner, term, tf: an example, the number of a word it holds, and how often it does."""
        n = len(doc_ids)
        x = (1 + np.log(tf)) * weight[term]
        x /= np.sqrt(np.bincount(owner, x * x, n))[owner]
        order = arranged(owner, term, x, n, len(words))
        del x
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        by = np.lexsort((place[owner], term))
        return cls(words if isinstance(words, Numbers) else numbered(words), weight, doc_ids[order], labels[order], np.bincount(term, minlength=len(words)).astype(np.int32), place[owner][by], tf[by].astype(np.int32))

    def __reduce__(self):
        return Index, self.source

    def shared(self, spark: SparkSession):
        """Its one broadcast; the scale is not part of it."""
        if self.broadcast is None:
            self.broadcast = spark.sparkContext.broadcast(self)
        return self.broadcast

    def nearest(self, queries: list[dict[int, int]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of each query's k nearest examples with a cosine above 0; counts are by a word's number; `skip`: doc_ids that are not their query's neighbours."""
        cells = [(i, t, n) for i, q in enumerate(queries) for t, n in sorted(q.items())]
        owner, term, tf = np.array(cells, np.int64).reshape(-1, 3).T
        return self.nearest_of(len(queries), owner, term, tf, k, skip)

    def nearest_of(self, n: int, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for n queries as `counted` gives them."""
        x = (1 + np.log(tf)) * self.weight[term]
        x /= np.maximum(np.sqrt(np.bincount(owner, x * x, n)), 1e-300)[owner]
        column = self.column[term]
        out = []
        for first in range(0, n, QUERIES):
            many = min(QUERIES, n - first)
            a, b = np.searchsorted(owner, (first, first + many))
            held, over = column[a:b] >= 0, np.zeros((many, len(self.columns)))
            over[(owner[a:b] - first)[held], column[a:b][held]] = x[a:b][held]
            sums = over @ self.columns
            bounds = sums.reshape(many, self.blocks, BLOCK).max(2)
            q, t, w = (owner[a:b] - first)[~held], term[a:b][~held], x[a:b][~held]
            lengths = self.entries[t + 1] - self.entries[t]
            entry = spans(self.entries[t], lengths)
            bounds += np.bincount(np.repeat(q * self.blocks, lengths) + self.block[entry], np.repeat(w, lengths) * self.maxima[entry], bounds.size).reshape(bounds.shape)
            cuts, ends = np.searchsorted(q, np.arange(many + 1)), np.append(0, np.cumsum(lengths))
            for i in range(many):
                mine = slice(cuts[i], cuts[i + 1])
                entries = entry[ends[cuts[i]] : ends[cuts[i + 1]]]
                out.append(self._nearest(sums[i], bounds[i], t[mine], w[mine], entries, np.repeat(w[mine], lengths[mine]), k, skip[first + i] if skip else None))
        return out

    def _nearest(self, sums: np.ndarray, bounds: np.ndarray, t: np.ndarray, weight: np.ndarray, entry: np.ndarray, each: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """One query: its sums over the columns, its bounds by block but for the rows, the other words and their weights, their entries and those's words' weights."""
        row = self.row[t]
        rows, x, block = row[row >= 0], weight[row >= 0], self.block[entry]
        begins = self.begins[rows]
        bounds = bounds + x @ self.tallest[rows]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        first, step = 0, AT_ONCE
        while first < len(order):
            least = best[-1] - 1e-9 if len(best) >= k else 1e-12
            open_ = order[first:][bounds[order[first:]] >= least]
            if not len(open_):
                break
            if first and len(open_) * WHOLE >= self.blocks:
                lo, n = self.lists[t], self.lists[t + 1] - self.lists[t]
                total = self._sums(lo, n, weight, len(sums))
                total = sums + total
                docs = np.flatnonzero(total[: len(self.doc_ids)] >= least - 1e-12)
                return self._best(docs, total[docs], least, k, skip)
            blocks = open_[:step]
            chosen = np.zeros(self.blocks, bool)
            chosen[blocks] = True
            held = np.flatnonzero(chosen[block])
            lo = np.concatenate([begins[:, blocks].ravel(), self.starts[entry[held]]])
            n = np.concatenate([begins[:, blocks + 1].ravel(), self.stops[entry[held]]]) - lo
            total = self._sums(lo, n, np.concatenate([np.repeat(x, len(blocks)), each[held]]), len(sums))
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[docs < len(self.doc_ids)]
            best_at, best = self._best(np.concatenate([best_at, docs]), np.concatenate([best, sums[docs] + total[docs]]), least, k, skip)
            first, step = first + step, 4 * step
        return best_at, best

    def _sums(self, lo: np.ndarray, n: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """The spans of postings, n from lo on, times their weights, summed by example."""
        posting, each = spans(lo, n), np.repeat(weight, n)
        each *= self.x.take(posting)
        return np.bincount(self.docs.take(posting), each, size)

    def _best(self, docs: np.ndarray, cosines: np.ndarray, least: float, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these examples, of those with `least`; equal examples get equal cosines, however their sums were rounded, and the smaller id goes first."""
        kept = cosines >= least - 1e-12
        if skip is not None:
            kept &= self.doc_ids[docs] != skip
        docs, cosines = docs[kept], cosines[kept]
        if len(docs) > k:
            kept = cosines >= np.partition(cosines, -k)[-k] - 1e-11
            docs, cosines = docs[kept], cosines[kept]
        cosines = np.round(cosines, 12)
        docs, cosines = docs[cosines >= 1e-12], cosines[cosines >= 1e-12]
        top = np.lexsort((self.doc_ids[docs], -cosines))[:k]
        return docs[top], cosines[top]

    def votes(self, n: int, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int, skip: list[int] | None = None) -> list[tuple[float | None, list[int]]]:
        """For each of n queries (as `counted` gives them) the share of toxic votes, weighted by 1 / distance, and the neighbours' ids; None without neighbours."""
        out = []
        for at, cosines in self.nearest_of(n, owner, term, tf, k, skip):
            weight = 1 / (1.02 - np.minimum(cosines, 1))
            out.append((float((weight * self.labels[at]).sum() / weight.sum()) if len(at) else None, self.doc_ids[at].tolist()))
        return out

    def votes_of(self, texts: list[str], k: int) -> list[tuple[float | None, list[int]]]:
        """The votes on texts, equal ones voted on once; those on the last texts are remembered, since copies often stand together."""
        keys = [xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass")) for text in texts]
        if len(self.remembered) >= REMEMBERED:
            self.remembered.clear()
        new = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.remembered}
        self.remembered.update(zip(new, self.votes(len(new), *counted(list(new.values()), self.number), k), strict=True))
        return [self.remembered[key] for key in keys]


def sample(marked: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows / 2 of each label, those with the smallest hashes of their ids."""
    order = (F.xxhash64(F.lit(2), "doc_id"), "doc_id")
    return marked.where("label = 1").orderBy(*order).limit(max_rows // 2).union(marked.where("label = 0").orderBy(*order).limit(max_rows // 2))


def word_counts(examples: DataFrame) -> DataFrame:
    """doc_id, label, terms, counts of the examples."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            found = [Counter(terms(text)) for text in texts]
            arrays = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *arrays], ["doc_id", "label", "terms", "counts"])

    return examples.select("doc_id", "label", "text").mapInArrow(counted, "doc_id long, label int, terms array<string>, counts array<int>")


def document_counts(docs: DataFrame, number: Numbers) -> tuple[int, np.ndarray]:
    """All documents, and those that hold each of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        seen = np.zeros(len(number) + 1, np.int64)
        for _, texts in pieces(batches):
            seen += np.bincount(counted(texts, number)[1], minlength=len(seen))
            seen[-1] += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["term", "df"])

    rows = docs.select("text").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(number) + 1, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    shared.destroy()
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, k: int = 15) -> Index | None:
    """The index, from at most `max_rows` labelled documents, or None without examples of both kinds. `max_rows` bounds what is broadcast: the words of so many texts."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    totals = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    with Frames(docs.sparkSession) as frames:
        labelled = docs.select("doc_id", "text").join(F.broadcast(sample(marked, max_rows)), "doc_id")
        examples = labelled.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        held = frames.save(word_counts(examples))
        rows = held.toArrow().combine_chunks().sort_by("doc_id")
        y = rows.column("label").to_numpy()
        if not (y == 0).any() or not (y == 1).any():
            return None
        lists = rows.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        number, term, ids = numbered(coded.dictionary.to_pylist()), coded.indices.to_numpy().copy(), rows.column("doc_id").to_numpy()
        owner, tf = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy()), rows.column("counts").combine_chunks().flatten().to_numpy().copy()
        del rows, lists, coded  # the driver holds one form of the examples at a time
        documents, df = document_counts(docs, number)
        toxic, clean = (np.bincount(term, y[owner] == label, len(number)) for label in (1, 0))
        index = Index.of(number, term_weights(df, documents, toxic, clean, int((y == 1).sum()), int((y == 0).sum())), ids, y, owner, term, tf)
        del owner, term, tf
        weight = {label: totals[label] / int((y == label).sum()) for label in (0, 1)}
        index.scale = Scale([(r.share, r.label, weight[r.label]) for r in votes_without_self(held, index, k).collect()])
    return index


def votes_without_self(held: DataFrame, index: Index, k: int) -> DataFrame:
    """label, share: how the other examples vote on each example."""
    shared = index.shared(held.sparkSession)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first in range(0, len(batch), QUERIES):
                part = batch.slice(first, QUERIES)
                words, tf = (part.column(c).flatten() for c in ("terms", "counts"))
                owner = np.repeat(np.arange(len(part)), part.column("terms").value_lengths().to_numpy())
                term = index.number.of([w.encode() for w in words.to_pylist()])
                by = np.lexsort((term, owner))
                shares = [share for share, _ in index.votes(len(part), owner, term[by], tf.to_numpy()[by], k, part.column("doc_id").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(shares, pa.float64())], ["label", "share"])

    return held.repartition(shuffle_partitions(held.sparkSession), "doc_id").mapInArrow(voted, "label int, share double")


def score(docs: DataFrame, index: Index | None, k: int = 15) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) of every document."""
    shared, scale = (index.shared(docs.sparkSession), index.scale) if index else (None, Scale([]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            found = [(scale.score(share), near) for share, near in shared.value.votes_of(texts, k)] if shared else [(0.0, []) for _ in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
