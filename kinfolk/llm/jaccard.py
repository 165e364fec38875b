"""N-gram Jaccard self-join with signature trees.

Two documents link when the Jaccard similarity of their sets of distinct word shingles reaches `threshold_pct` per cent;
`components` gives each document the smallest doc_id it reaches by links.

How it works, no link being lost at any step:

1. Each text becomes the sorted set of its shingle hashes. From it come the class (a hash of the set: equal sets are one class), the signature (the
   distinct places of its shingles among 65,536 bits), and the prefix: the shingles that come first in one global order, of which linked sets share
   one. Shingles that many documents hold come last in that order; the list that says which those are is only a hint, of bounded size, and any list
   gives the same links.
2. Families: each class is compared with two hubs of each of its MINHASHES buckets, the smallest class and the one richest in frequent shingles (most
   like the text that others are copies of). A class meets at most 2 * MINHASHES others here, however many copies there are.
3. Groups: classes that share a prefix shingle, cut where sizes lie too far apart. Groups of the same members are one; large groups that hold nearly
   the same are put together. Groups of one family are left out.
4. Each group makes signature trees of the classes' bitmaps (signatures folded to two bits a shingle or more), one for each range of sizes: nodes hold the OR of
   the bitmaps below, the range of set sizes and of families. A dual traversal drops each pair of nodes of one family, and each in which no pair of
   sets can overlap enough. The pairs of leaves left are compared by their signatures. Of pairs that may link, those that connect two families not yet connected are handed on, so that a group gives fewer pairs than
   it has families. Groups of more than BLOCK sets are dealt to tasks by pairs of blocks; the largest family's blocks never meet each other.
5. Pairs are compared shingle by shingle. Where one does not link, others it stood for may: what is left of those groups is searched again, by the sets of shingles
   themselves in place of signatures, so that only pairs that link connect families. No search hands on more pairs in a task than it has sets.
6. Components come from the links between classes, by smallest labels and pointer jumping.

Cases: a null or wordless text has an empty set and links with nothing; fewer words than a shingle make one shingle of them all; rows with a null doc_id are
linked as others are (a component of such rows alone has a null component_id); each row of a repeated doc_id is judged by its own text; no rows give no rows.
Other columns only tell rows apart in `keep_one`. Shingles and classes are told apart by 64 bits: among 10^9 different texts, a false match is expected to come up 0.03 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Frames, give_back, mix64, pieces, shuffle_partitions, word_hashes

#: Odd multipliers (fixed values) that give the words of a shingle their places.
PLACE, SIZE_SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Shingles counted together when looking for frequent ones, the local count that is reported, the least count and the length of the hint list.
CHUNK, REPORT_DF, HINT_DF, HINTS = 1 << 21, 3, 24, 1 << 18
#: Minhashes that make buckets, and those (the same and more) of which a byte each makes a set's sketch; so many bytes agree in a pair worth comparing early.
MINHASHES, SKETCH, AGREE = 4, 8, 6
#: Odd multipliers of the minhashes: each gives shingle hashes another order.
MINHASH = [mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(SKETCH)]
MIN_BITS, MAX_BITS, BITS_PER_SHINGLE = 128, 1 << 16, 2
#: Bits of the filter of wanted ids that goes to all executors.
FILTER_BITS = 1 << 21
FANOUT = 8
#: Sets of a group that one task takes; a larger group goes to tasks by pairs of its blocks.
BLOCK = 1024
#: Groups of more members are put together with others that hold nearly the same.
LARGE = 8
#: What stands in front of an entry block: numbers of classes and of entries. Then come classes, their sizes, and of each entry the shingle's upper 32 and next 8 bits and
#: the class's place in the block with a low bit that is 0 in the first part of the prefix.
HEAD = np.dtype([("classes", "<i8"), ("entries", "<i8")])


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(texts)
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            rolled = rolled * PLACE + hashes[k : len(hashes) - n + 1 + k]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64) * SIZE_SALT
            for w in hashes[a:b]:
                h = mix64((h ^ w) * PLACE)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(hashes: np.ndarray) -> int:
    """A hash of the whole set."""
    return int((np.bitwise_xor.reduce(mix64(hashes * PLACE)) ^ np.sum(hashes, dtype=np.uint64)).view(np.int64)) if len(hashes) else 0


def signature(hashes: np.ndarray) -> np.ndarray:
    """The distinct places of the shingles among MAX_BITS bits. Places modulo a power of two make a bitmap of that width."""
    return np.unique(hashes.astype(np.uint16))


def width(size: int) -> int:
    """Bits of the bitmap of a set."""
    bits = MIN_BITS
    while bits < min(BITS_PER_SHINGLE * size, MAX_BITS):
        bits *= 2
    return bits


def bitmap(places: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[places & (bits - 1)] = True
    return np.packbits(out, bitorder="little")


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The commonest shingles by document count, rarest first; at most HINTS of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            token, df = np.unique(np.concatenate(held), return_counts=True)
            often = df >= REPORT_DF
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(df[often].astype(np.int64))], ["token", "df"])

        for _, texts in pieces(batches):
            for s in shingle_sets(texts, n):
                held.append(s)
                size += len(s)
            if size >= CHUNK:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    counted = docs.select("text").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    top = counted.where(F.col("df") >= HINT_DF).orderBy(F.desc("df"), "token").limit(HINTS).select("token").toArrow()
    return np.flip(top.column("token").to_numpy()).view(np.uint64)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map<" not in t])


def profiles(docs: DataFrame, n: int, threshold_pct: int, hints: np.ndarray) -> DataFrame:
    """doc_id, tie (a hash of the row), n_shingles, class, common (shingles among the hints), minhashes, sketch, prefix in the global order, bitmap, signature."""
    order = np.argsort(hints)
    shared = docs.sparkSession.sparkContext.broadcast((hints[order], order.astype(np.int64)))
    minhashes = [f"m{k}" for k in range(MINHASHES)]
    names = ["doc_id", "tie", "n_shingles", "class", "common", *minhashes, "sketch", "prefix", "bitmap", "signature"]
    kinds = [pa.int64()] * (4 + MINHASHES) + [pa.binary()] * 3

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = shared.value
        for part, texts in pieces(batches):
            rows = []
            for s in shingle_sets(texts, n):
                m, common = len(s), 0
                if not m:
                    rows.append((0,) * (4 + MINHASHES) + (None,) * 3)
                    continue
                want, sorted_ = m - -(-threshold_pct * m // 100) + 1, s
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    hot = tokens[at] == s
                    common = int(hot.sum())
                    if common:
                        sorted_ = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])
                least = mix64(np.array([(s * odd).min() for odd in MINHASH]))
                sketch = int(least.astype(np.uint8).view(np.int64)[0])
                places = signature(s)
                rows.append((m, class_of(s), common, *least[:MINHASHES].view(np.int64).tolist(), sketch, sorted_[:want].tobytes(), bitmap(places, width(m)).tobytes(), places.tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), *columns], names)

    read = docs.select("doc_id", row_hash(docs).alias("tie"), "text")
    return read.mapInArrow(profile, "doc_id long, tie long, n_shingles long, class long, common long, " + "".join(f"{m} long, " for m in minhashes) + "sketch long, prefix binary, bitmap binary, signature binary")


def slots(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size that has the hash of every id of the only column; a partition sends the places of its own ids, or all bits if that is less."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[slots(batch.column(0))] = True
        places = np.flatnonzero(bits).astype(np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([places if len(places) < FILTER_BITS // 8 else None], pa.binary()), pa.array([None if len(places) < FILTER_BITS // 8 else np.packbits(bits).tobytes()], pa.binary())], ["places", "bits"])

    bits = np.zeros(FILTER_BITS, bool)
    for row in ids.mapInArrow(mark, "places binary, bits binary").toLocalIterator():
        if row.bits is None:
            bits[np.frombuffer(row.places, np.int32)] = True
        else:
            bits |= np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return bits


def wanted(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose `column` may be among `ids`: a filter of fixed size spares the others the shuffle. Others may pass; a join follows."""
    shared = rows.sparkSession.sparkContext.broadcast(id_filter(ids))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[slots(batch.column(column))]))

    return rows.mapInArrow(some, rows.schema)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def overlaps(x: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """At most how many shingles the set (signature x, n shingles) shares with each of the others; `scratch`: MAX_BITS zeros, left as they were."""
    scratch[x] = 1
    lengths = np.array([len(o) for o in others])
    met = np.add.reduceat(scratch[np.concatenate(others)], np.cumsum(lengths) - lengths, dtype=np.int64)
    scratch[x] = 0
    return np.minimum(met + np.minimum(n - len(x), sizes - lengths), np.minimum(n, sizes))


def sets_of(classes: DataFrame, known: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """class, shingles (sorted) of each of `classes` (class). Only their texts are hashed again; no text leaves the scan."""
    need = known.join(classes, "class", "left_semi").select("class", F.col("first_tie").alias("tie"))
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(need.select("tie")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batch.filter(pa.array(shared.value[slots(batch.column("tie"))])) for batch in batches):
            sets = shingle_sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "shingles"])

    return docs.select(row_hash(docs).alias("tie"), "text").mapInArrow(hashed, "class long, shingles binary").join(need.select("class"), "class", "left_semi").dropDuplicates(["class"])


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, n: int, threshold_pct: int) -> DataFrame:
    """a, b, linked of each of `pairs`, compared shingle by shingle."""
    sets = sets_of(ends(pairs), known, docs, n)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= threshold_pct * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, linked boolean")


def hub_pairs(known: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b) of each class and the two hubs of each of its minhash buckets, if their sizes allow a link and their sketches make one likely."""
    hashes = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(MINHASHES)))
    entries = known.select("class", "n_shingles", "common", "sketch", F.explode(hashes).alias("at")).select("class", "n_shingles", "common", "sketch", "at.k", "at.m")
    hubs = {"least": F.min(F.struct("class", "n_shingles", "sketch")), "richest": F.max(F.struct("common", "n_shingles", "class", "sketch"))}
    buckets = entries.groupBy("k", "m").agg(*(hub.alias(name) for name, hub in hubs.items()), F.count("*").alias("held")).where("held > 1").drop("held")
    met = entries.drop("common").join(buckets, ["k", "m"])
    both = [met.select("class", "n_shingles", F.col(hub)["class"].alias("hub"), F.col(hub)["n_shingles"].alias("size"), F.col("sketch").bitwiseXOR(F.col(hub)["sketch"]).alias("differ")) for hub in hubs]
    agree = sum((F.shiftright("differ", 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(SKETCH))
    fits = F.expr(f"class <> hub and 100 * n_shingles >= {threshold_pct} * size and 100 * size >= {threshold_pct} * n_shingles")
    near = both[0].union(both[1]).where(fits & (agree >= AGREE))
    return near.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def group_keys(members: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each stretch of `members`: equal for equal stretches and, for most large ones that hold nearly the same, too."""
    mixed = mix64(members.view(np.uint64) * PLACE)
    keys = mix64(np.bitwise_xor.reduceat(mixed, starts) + sizes.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(sizes > LARGE):
        two = np.partition(mixed[starts[i] : starts[i] + sizes[i]], 1)[:2]
        keys[i] = mix64(two[:1] ^ mix64(two[1:]))[0]
    return keys


def prefix_groups(rows: DataFrame, threshold_pct: int, entries: int) -> DataFrame:
    """Groups (grp, class) of classes that share a prefix shingle and whose sizes may fit."""
    parts = shuffle_partitions(rows.sparkSession, entries, 1 << 20)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of distinct entries (shingle, class), one for each partition of the shingles: a class's many copies count once here."""
        held, of, sizes, size = [], [], [], 0

        def blocks() -> pa.RecordBatch:
            token, place = (np.concatenate(c) for c in zip(*held, strict=True))
            classes, at = np.unique(np.array(of, np.int64), return_index=True)
            m = np.array(sizes, np.int32)[at]
            place = (np.searchsorted(classes, np.array(of, np.int64))[place >> 1] << 1 | place & 1).astype(np.int64)
            bucket = (mix64(token) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((place, token, bucket))
            bucket, token, place = bucket[order], token[order], place[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (place[1:] != place[:-1])])
            bucket, token, place = bucket[new], token[new], place[new]
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            some, out = np.flatnonzero(np.diff(cuts)), []
            for i in some:
                t, p = token[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]]
                here, local = np.unique(p >> 1, return_inverse=True)
                head = np.array([(len(here), len(t))], HEAD)
                columns = (classes[here], m[here], (t >> np.uint64(32)).astype("<u4"), (t >> np.uint64(24)).astype(np.uint8), (local << 1 | p & 1).astype("<u4"))
                out.append(b"".join(c.tobytes() for c in (head, *columns)))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "block"])

        for batch in batches:
            for prefix, c, m in zip(batch.column("prefix"), batch.column("class").to_pylist(), batch.column("n_shingles").to_pylist(), strict=True):
                token = np.frombuffer(prefix.as_buffer(), np.uint64)
                # of two linked sets, the smaller has a shared shingle in this first part of its prefix
                first = m - -(-2 * threshold_pct * m // (100 + threshold_pct)) + 1
                held.append((token, len(of) << 1 | (np.arange(len(token)) >= first)))
                of.append(c)
                sizes.append(min(m, 2**31 - 1))
                size += len(token)
            if size >= CHUNK // 4:
                yield blocks()
                held, of, sizes, size = [], [], [], 0
        if size:
            yield blocks()

    def unpacked(block: bytes) -> tuple[np.ndarray, ...]:
        """shingle (its upper 40 bits), class, size, whether it is late in the prefix."""
        k, e = np.frombuffer(block, HEAD, 1)[0].tolist()
        at = np.cumsum([HEAD.itemsize, 8 * k, 4 * k, 4 * e, e])
        classes, m, upper, lower, place = (np.frombuffer(block, kind, n, offset) for kind, n, offset in zip(("<i8", "<i4", "<u4", "u1", "<u4"), (k, k, e, e, e), at.tolist(), strict=True))
        return upper.astype(np.uint64) << np.uint64(8) | lower, classes[place >> 1], m[place >> 1], (place & 1).astype(bool)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(b) for batch in batches for b in batch.column("block").to_pylist()]
        if not held:
            return
        token, of, m, late = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        # most shingles stand alone: the others are sorted by size, and put those first that have the shingle early
        order = np.argsort(token)
        twin = token[order[1:]] == token[order[:-1]]
        some = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]
        token, of, m, late = token[some], of[some], m[some].astype(np.int64), late[some]
        order = np.lexsort((of, late, m, token))
        token, of, m, late = token[order], of[order], m[order], late[order]
        if not len(of):
            return
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (of[1:] != of[:-1])])
        token, of, m, late = token[new], of[new], m[new], late[new]
        apart = np.concatenate([[True], (token[1:] != token[:-1]) | (100 * m[:-1] < threshold_pct * m[1:])])
        starts = np.flatnonzero(apart)
        # who comes before the first with the shingle in its first part has no smaller partner here
        opens = np.minimum.reduceat(np.where(late, len(late), np.arange(len(late))), starts)
        stretch = np.cumsum(apart) - 1
        kept = np.arange(len(late)) >= opens[stretch]
        stretch, of = stretch[kept], of[kept]
        if not len(of):
            return
        starts = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        sizes = np.diff(np.append(starts, len(of)))
        several = np.repeat(sizes > 1, sizes)
        of, sizes = of[several], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        grp = np.repeat(group_keys(of, starts, sizes), sizes).view(np.int64)
        for a in range(0, len(of), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(grp[a : a + (1 << 18)]), pa.array(of[a : a + (1 << 18)])], ["grp", "class"])

    blocks = rows.where("n_shingles > 0").select("prefix", "class", "n_shingles").mapInArrow(pack, "bucket int, block binary").repartition(parts, "bucket")
    return blocks.select("block").mapInArrow(meet, "grp long, class long").distinct()


class SignatureTree:
    """Levels of OR-combined bitmaps of `bits` bits with the range of sizes and the most shingles beyond distinct bits.

    `tags` number the leaves: pairs of leaves with an equal number in any of them are not wanted. Leaves with equal numbers best stand together.
    """

    def __init__(self, sizes: np.ndarray, signatures: list[np.ndarray], bits: int, tags: tuple[np.ndarray, ...] = ()):
        leaf = np.zeros((len(sizes), bits // 64), np.uint64)
        for a in range(0, len(sizes), 64):
            some = signatures[a : a + 64]
            plain = np.zeros((len(some), bits), bool)
            plain[np.repeat(np.arange(len(some)), [len(s) for s in some]), np.concatenate(some) & (bits - 1)] = True
            leaf[a : a + 64] = np.packbits(plain, axis=1, bitorder="little").view(np.uint64)
        extra = sizes - np.bitwise_count(leaf).sum(axis=1).astype(np.int64)
        self.levels = [(leaf, sizes, sizes, extra, [(t, t) for t in tags])]
        while len(self.levels[-1][1]) > 1:
            bits_, low, high, extra, spans = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            spans = [(np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)) for a, b in spans]
            self.levels.append((np.bitwise_or.reduceat(bits_, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at), spans))

    def pairs(self, other: SignatureTree, threshold_pct: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves, one of each tree, that may still reach the threshold, by a dual traversal; with itself, pairs i < j."""
        same = self is other
        i = j = np.zeros(1, np.int64)
        child = np.arange(FANOUT)
        top = max(len(self.levels), len(other.levels)) - 1
        for depth in range(top, -1, -1):
            mine, its = (t.levels[min(depth, len(t.levels) - 1)] for t in (self, other))
            if depth < top:
                # a lower tree's root waits until the other has come down to its level
                down, down_other = depth < len(self.levels) - 1, depth < len(other.levels) - 1
                i, j = np.broadcast_arrays(*(x[:, None, None] * (FANOUT if d else 1) + (child if d else np.zeros(1, np.int64)).reshape(shape) for x, d, shape in ((i, down, (-1, 1)), (j, down_other, (1, -1)))))
                i, j = i.ravel(), j.ravel()
                real = (i < len(mine[1])) & (j < len(its[1]))
                if same:
                    real &= i <= j if depth else i < j
                i, j = i[real], j[real]
            elif same and not depth:
                i = j = np.zeros(0, np.int64)
            for (first, last), (first2, last2) in zip(mine[4], its[4], strict=True):
                different = (first[i] != last[i]) | (first2[j] != last2[j]) | (first[i] != first2[j])
                i, j = i[different], j[different]
            keep = np.zeros(len(i), bool)
            for a in range(0, len(i), 1 << 14):
                x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                # sizes p, q need overlap >= t (p + q) / (1 + t), and t max(p, q) <= min(p, q); both at their loosest in the nodes' ranges
                fits = (100 * its[2][y] >= threshold_pct * mine[1][x]) & (100 * mine[2][x] >= threshold_pct * its[1][y])
                overlap = np.bitwise_count(mine[0][x] & its[0][y]).sum(axis=1).astype(np.int64) + np.minimum(mine[3][x], its[3][y])
                keep[a : a + (1 << 14)] = fits & ((100 + threshold_pct) * np.minimum(overlap, np.minimum(mine[2][x], its[2][y])) >= threshold_pct * (mine[1][x] + its[1][y]))
            i, j = i[keep], j[keep]
        return i, j


def candidates(sizes: np.ndarray, signatures: list[np.ndarray], tags: tuple[np.ndarray, ...], threshold_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that signature trees do not rule out: a tree for each range of sizes, each traversed with itself and the next.

    Of the signatures, the places modulo the width of the set's bitmap are enough.
    """
    # sets that may link are of one range or of two that adjoin
    span = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / threshold_pct) + 1e-9).astype(np.int64)
    order = np.lexsort((sizes, *tags[::-1], span))
    span, found = span[order], []
    ranges = [order[span == s] for s in np.unique(span)]
    numbers = np.unique(span)

    def tree(at: np.ndarray, bits: int) -> SignatureTree:
        return SignatureTree(sizes[at], [signatures[k] for k in at], bits, tuple(t[at] for t in tags))

    for k, at in enumerate(ranges):
        bits = width(int(sizes[at].min()))
        own = tree(at, bits)
        i, j = own.pairs(own, threshold_pct)
        found.append((at[i], at[j]))
        if k + 1 < len(ranges) and numbers[k + 1] == numbers[k] + 1:
            i, j = own.pairs(tree(ranges[k + 1], bits), threshold_pct)
            found.append((at[i], ranges[k + 1][j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def exact_overlaps(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles the sorted set x shares with each of the others."""
    at = (np.searchsorted(x, y) for y in others)
    return np.array([np.count_nonzero(x[np.minimum(a, len(x) - 1)] == y) for a, y in zip(at, others, strict=True)], np.int64)


def group_pairs(family: np.ndarray, sizes: np.ndarray, signatures: list[np.ndarray], tags: tuple[np.ndarray, ...], threshold_pct: int, scratch: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of sets of different families that may link, and only those that connect what was not connected before. Without `scratch`, the signatures are the sets themselves, and the pairs do link."""
    i, j = candidates(sizes, signatures, tags, threshold_pct)
    if not len(i):
        return []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    root, out = np.unique(family, return_inverse=True)[1], []
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(i)), strict=True):
        x, others = int(i[a]), j[a:b]
        others = others[root[others] != root[x]]
        if not len(others):
            continue
        those = [signatures[y] for y in others]
        shared = exact_overlaps(signatures[x], those) if scratch is None else overlaps(signatures[x], int(sizes[x]), those, sizes[others], scratch)
        for y in others[(100 + threshold_pct) * shared >= threshold_pct * (sizes[x] + sizes[others])].tolist():
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[y]] = root[x]
    return out


def by_task(batches: Iterator[pa.RecordBatch], binary: str) -> Iterator[tuple[dict[str, np.ndarray], list[bytes]]]:
    """The rows of each task (they come together): its columns, and the values of the binary one."""
    held: list[tuple[dict, list]] = []
    last = None

    def whole() -> tuple[dict[str, np.ndarray], list[bytes]]:
        return {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}, [x for h in held for x in h[1]]

    for batch in batches:
        columns = {c: batch.column(c).to_numpy() for c in batch.schema.names if c != binary}
        values, task = batch.column(binary).to_pylist(), columns["task"]
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and task[a] != last:
                yield whole()
                held = []
            held.append(({c: x[a:b] for c, x in columns.items()}, values[a:b]))
            last = task[a]
    if held:
        yield whole()
    held = []
    give_back()


def tags_of(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Pairs of one family are not wanted; in a task of two blocks, the pairs inside either are left to that block's own task."""
    return (rows["family"], rows["block"]) if (rows["block"] != rows["other"]).any() else (rows["family"],)


def dealt(groups: DataFrame, known: DataFrame) -> DataFrame:
    """task, family, row, block, other: each group (grp, class, family) is a task, or one for each pair of its blocks of BLOCK sets that holds pairs of two families."""
    by_family = groups.groupBy("grp", "family").agg(F.count("*").alias("c"))
    large = by_family.groupBy("grp").agg(F.sum("c").alias("total"), F.max(F.struct("c", "family")).alias("most")).where(F.col("total") > BLOCK)
    large = large.select("grp", F.col("most.family").alias("most"), F.ceil(F.col("most.c") / BLOCK).alias("own"), F.ceil((F.col("total") - F.col("most.c")) / BLOCK).alias("rest"))
    placed = groups.join(large, "grp", "left")
    mine, hashed = F.col("family") == F.col("most"), F.xxhash64("class")
    placed = placed.withColumn("block", F.coalesce(F.when(mine, F.pmod(hashed, F.col("own"))).otherwise(F.col("own") + F.pmod(hashed, F.col("rest"))), F.lit(0)).cast("long"))
    others = F.when(F.col("own").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(mine, F.col("own")).otherwise(F.lit(0)).cast("long"), (F.col("own") + F.col("rest") - 1).cast("long")))
    placed = placed.withColumn("other", F.explode(others))
    task = F.when(F.col("own").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")))
    return placed.withColumn("task", task).join(known.select("class", "row"), "class").select("task", "family", "row", "block", "other")


def tree_pairs(groups: DataFrame, known: DataFrame, rows: DataFrame, threshold_pct: int, frames: Frames, docs: DataFrame | None = None, n: int = 0) -> DataFrame:
    """Pairs (a, b) of classes from different families of one of `groups` (grp, class, family) that may link, fewer in each task than it has sets; `known` names a row of each class.

    The trees are made of bitmaps; of the sets in pairs that they leave, signatures follow. Given `docs` and the words of a shingle, the sets themselves follow, and the pairs do link.
    """
    parts, exact = shuffle_partitions(groups.sparkSession), docs is not None

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, bitmaps in by_task(batches, "bitmap"):
            places = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) for x in bitmaps]
            i, j = candidates(of["n_shingles"], places, tags_of(of), threshold_pct)
            some = np.unique(np.concatenate([i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(of[c][some]) for c in ("task", "family", "row", "block", "other")], ["task", "family", "row", "block", "other"])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = None if exact else np.zeros(MAX_BITS, np.uint8)
        for of, signatures in by_task(batches, "signature"):
            places = [np.frombuffer(x, np.uint64 if exact else np.uint16) for x in signatures]
            found = np.array(group_pairs(of["family"], of["n_shingles"], places, tags_of(of), threshold_pct, scratch), np.int64).reshape(-1, 2)
            a, b = of["class"][found[:, 0]], of["class"][found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def together(placed: DataFrame, *columns: str) -> DataFrame:
        some = wanted(rows.select("row", *columns), "row", placed.select("row"))
        return some.join(placed, "row").repartition(parts, "task").sortWithinPartitions("task")

    placed = frames.save(dealt(groups, known))
    left = frames.save(together(placed, "n_shingles", "bitmap").mapInArrow(sift, placed.schema))
    if not exact:
        return together(left, "class", "n_shingles", "signature").mapInArrow(traverse, "a long, b long").distinct()
    of = left.join(known.select("row", "class", "n_shingles"), "row")
    sets = frames.save(sets_of(of.select("class").distinct(), known, docs, n))
    whole = of.join(sets.select("class", F.col("shingles").alias("signature")), "class").select("class", "n_shingles", "signature", "task", "family", "row", "block", "other")
    return whole.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(traverse, "a long, b long").distinct()


def of_families(groups: DataFrame, found: DataFrame) -> DataFrame:
    """grp, class, family (the label that `found` gives the class), without the groups of one family."""
    named = groups.select("grp", "class").join(found.select(F.col("node").alias("class"), "label"), "class", "left").select("grp", "class", F.coalesce("label", "class").alias("family"))
    several = named.groupBy("grp").agg((F.min("family") < F.max("family")).alias("several")).where("several")
    return named.join(several.select("grp"), "grp", "left_semi")


def connected(edges: DataFrame, frames: Frames) -> DataFrame:
    """node, label (the smallest node it reaches) of every node named in `edges` (a, b)."""
    both = frames.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = frames.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jumped = hooked.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        moved = frames.save(jumped.select("node", F.least("next", "far").alias("label"), F.col("old")))
        if moved.where("label <> old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def links(rows: DataFrame, known: DataFrame, docs: DataFrame, n: int, threshold_pct: int, frames: Frames) -> DataFrame:
    """Links (a, b) between classes that leave their components as all links would."""
    save = frames.save
    linked = save(verified(save(hub_pairs(known, threshold_pct)), known, docs, n, threshold_pct).where("linked").select("a", "b"))

    entries = (rows.agg(F.sum("n_shingles")).first()[0] or 0) * (100 - threshold_pct) // 100
    groups = save(of_families(prefix_groups(rows, threshold_pct, entries), connected(linked, frames)))
    compared = save(verified(save(tree_pairs(groups, known, rows, threshold_pct, frames)), known, docs, n, threshold_pct))
    linked = save(linked.union(compared.where("linked").select("a", "b")))
    failed = save(ends(compared.where("not linked")))
    if failed.isEmpty():
        return linked
    touched = groups.join(failed, "class", "left_semi").select("grp").distinct()
    left = save(of_families(groups.join(touched, "grp", "left_semi"), connected(linked, frames)))
    return save(linked.union(tree_pairs(left, known, rows, threshold_pct, frames, docs, n)))


def classified(docs: DataFrame, n: int, threshold_pct: int, frames: Frames) -> DataFrame:
    """doc_id, tie, n_shingles, class (0 without shingles), component (a class), component_id, class_id, n_copies of each document."""
    rows = frames.save(profiles(docs, n, threshold_pct, frequent_shingles(docs, n)).withColumn("row", F.monotonically_increasing_id()))
    minhashes = [f"m{k}" for k in range(MINHASHES)]
    slim = rows.where("n_shingles > 0").select("row", "class", "doc_id", "tie", "n_shingles", "common", "sketch", *minhashes)
    alike = [F.first(c).alias(c) for c in ("n_shingles", "common", "sketch", *minhashes)]
    known = frames.save(slim.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min("tie").alias("first_tie"), F.min("row").alias("row"), F.count("*").alias("n_copies"), *alike))
    found = connected(links(rows, known, docs, n, threshold_pct, frames), frames)
    named = known.select("class", "class_id", "n_copies").join(found.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("component", F.coalesce("label", "class"))
    least = named.where("label is not null").groupBy("component").agg(F.min("class_id").alias("least"))
    named = named.join(least, "component", "left").select("class", "component", "class_id", "n_copies", F.when(F.col("label").isNull(), F.col("class_id")).otherwise(F.col("least")).alias("component_id"))
    out = rows.select("doc_id", "tie", "n_shingles", "class").join(named, "class", "left")
    empty = F.col("n_shingles") == 0
    own = [F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")]
    return out.select("doc_id", "tie", "n_shingles", "class", "component", *own, F.when(empty, 1).otherwise(F.col("n_copies")).alias("n_copies"))


def components(docs: DataFrame, n: int = 5, threshold_pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set), n_copies (documents in that class)."""
    with Frames(docs.sparkSession) as frames:
        return frames.keep(classified(docs.select("doc_id", "text"), n, threshold_pct, frames).select("doc_id", "n_shingles", "component_id", "class_id", "n_copies"))


def keep_one(docs: DataFrame, n: int = 5, threshold_pct: int = 80) -> DataFrame:
    """One document of each component, the row with the smallest doc_id (null last; then by a hash of the row); documents without words stay, each."""
    with Frames(docs.sparkSession) as frames:
        rows = classified(docs, n, threshold_pct, frames).where("n_shingles > 0").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie").alias("row"), "component")
        first = rows.groupBy("component").agg(F.min("row").alias("first"))
        held = rows.join(first, "component").withColumn("stays", F.col("row") == F.col("first"))
        held = held.groupBy("row.tie", "row.none", "row.doc_id").agg(F.first("stays").alias("stays"), F.count("*").alias("same")).where("not stays or same > 1")
        held = frames.keep(held.select("tie", "doc_id", "stays"))
    # rows to drop, and rows that stay once for several that are the same in all columns
    tied = docs.withColumn("_tie", row_hash(docs))
    key = [tied["_tie"] == held.tie, tied.doc_id.eqNullSafe(held.doc_id)]
    alone = tied.join(held, key, "left_anti").select(docs.columns)
    if held.where("stays").isEmpty():
        return alone
    return alone.union(tied.join(held.where("stays"), key, "left_semi").dropDuplicates(["_tie", "doc_id"]).select(docs.columns))
