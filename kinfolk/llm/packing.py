"""Best-fit packing by a configuration linear program.

Documents become token ids, each followed by a separator id; only those longer than a sequence are cut. The histogram of piece lengths (at most
`capacity` numbers, whatever the input) is packed on the driver. The configuration LP: cover each length's count by configurations (multisets of lengths
that fit a sequence), as few as can be. Multiplicative weights: a length's price is its size times a weight that falls with what the configurations
chosen so far cover of it. A round prices by a knapsack dynamic program, whose table gives the best configuration around every length; those that
come near the best are raised by a small step each, the lengths most behind first. The sum of the steps is the fractional solution. Any prices bound the LP
from below (their sum over all pieces by the best configuration's worth), and `plan` returns the best such bound. The solution is rounded down, and what is left
goes by best fit: the largest piece, and the subset of the others that fills its sequence best. The plan (ranges of piece ranks for each length) is applied by
executors; pieces never meet in one task, as ranks come from counts of (length, salt).

Cases: a null or empty text is the separator alone; repeated rows are packed as often as they come (an equal row gets an equal
doc_id and piece, and its own place); a null doc_id is kept; no rows give no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import give_back, pieces, save

#: Chunks of text, and parts of them, whose ids are remembered by a Python worker; its memory is bounded by forgetting all when they are more.
REMEMBERED = 100_000
#: Signs up to here are parted as the tokenizer parts them; chunks with others (marks that combine, scripts that newer versions of Unicode may change) are encoded whole.
PLAIN = re.compile(r"[\x00-\u024F\u0400-\u045F\u2010-\u2027]*")
#: Marks that often end a word, and are a part of their own there.
ENDS = frozenset(["", *".,;:!?"])
PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


def byte_signs() -> dict[int, str]:
    """The sign that byte-level tokenizers write for each byte: itself where it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkIds(dict):
    """Token ids, as little-endian bytes, of text without spaces or line ends: the pre-tokenizer never joins across those.

    Where the tokenizer's own definition says that text is normalized (NFC, one space for many, lower case), then parted by a pattern whose matches are
    encoded each by itself, chunks are put together from their parts, and a part is encoded once for all its capitals and marks. Special tokens are
    looked for before the parting: chunks that may hold one are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.signs = byte_signs()
        self.model = self.tokenizer.model
        self.pattern = parting(json.loads(self.tokenizer.to_str()))

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            written = part if part.isascii() and part.isprintable() else "".join(map(self.signs.__getitem__, part.encode("utf-8", "surrogatepass")))
            tokens = self.model.tokenize(written)
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[chunk] = self._encoded(chunk)
        return ids

    def _encoded(self, chunk: str) -> bytes:
        if self.pattern is None or not (chunk.isascii() or PLAIN.fullmatch(chunk)):
            return self._direct(chunk)
        head, tail = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1:])
        lower = head.lower()
        if tail in ENDS and lower.isalpha():  # one word
            return self._part(lower) + self._part(tail) if tail else self._part(lower)
        if any(t in chunk for t in self.special):
            return self._direct(chunk)
        # no sign of PLAIN is lower-cased by its neighbours, as a sigma would be
        return b"".join(map(self._part, self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())))


def parting(definition: dict) -> regex.Pattern | None:
    """The pattern of a tokenizer's parts, from its own definition, if each part is encoded by itself; None for definitions of other kinds."""
    normalizers = (definition.get("normalizer") or {}).get("normalizers") or []
    kinds = [n["type"] for n in normalizers]
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = definition["model"]
    plain = kinds == ["NFC", "Replace", "Lowercase"] and normalizers[1]["pattern"] == {"Regex": r"\s+"} and normalizers[1]["content"] == " "
    plain = plain and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    plain = plain and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and model["type"] == "BPE" and not model["dropout"] and definition["post_processor"] is None
    return regex.compile(steps[0]["pattern"]["Regex"]) if plain else None


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """One for each Python worker, kept from task to task."""
    return ChunkIds(path)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, the columns of `carry`, piece, start, length, ids_crc32 and, if asked for, its ids."""
    end = np.array([separator], "<u4").tobytes()
    kept = ["doc_id", *carry]
    names = [*kept, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 4 + with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = chunk_ids(tokenizer_path)
        for part, texts in pieces(batches):
            owner, rows = [], []
            for i, text in enumerate(texts):
                chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ids = b"".join(map(ids_of.__getitem__, filter(None, chunks))) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    owner.append(i)
                    rows.append((k, at // 4, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<i4") if with_ids else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner, pa.int64())) for c in kept), *columns], names)
        # workers live on, and other operators' tasks need the room
        ids_of.clear()
        ids_of.parts.clear()
        give_back()

    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*kept, "text").mapInArrow(cut, f"doc_id long{carried}, {PIECE_COLUMNS}" + ", ids array<int>" * with_ids)


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best worth of each room up to `capacity`, and the length put in last to reach it (0: room left free): unbounded knapsack, one vector operation a unit of room."""
    down = np.full(capacity + 1, -np.inf)  # down[-l]: the price of length l
    down[capacity + 1 - lengths] = prices
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        with_one = worth[:room] + down[capacity + 1 - room :]
        best = int(with_one.argmax())  # of equals, the largest piece
        if with_one[best] > worth[room - 1]:
            worth[room], last[room] = with_one[best], room - best
        else:
            worth[room] = worth[room - 1]
    return worth, last


def filled(last: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length the knapsack's best filling of `room` holds."""
    used: dict[int, int] = {}
    while room > 0:
        size = int(last[room])
        if size:
            used[size] = used.get(size, 0) + 1
        room -= max(1, size)
    return used


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, batch: int, near: float, rate: float, power: float) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with fractional multiplicities that cover `counts`, and a lower bound of the LP: multiplicative weights on the covering LP.

    A round covers 1 / `rounds` of all, by up to `batch` configurations whose worth is at least 1 - `near` of the best. Lengths covered in full have no price. The
    rounds end when all is covered, or after four times `rounds`: what is not covered then is left to the rounding. Weights start from size ** `power`: above 1,
    large pieces are taken up first, and small ones are left for the rounding to fill up with.
    """
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    volume = float((lengths * counts).sum()) / capacity
    covered, bound = np.zeros(len(lengths)), 0.0
    chosen: dict[tuple, float] = {}
    for _ in range(4 * rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = lengths**power * np.exp(-rate * (covered - covered[open_].mean()))
        prices = np.where(open_, prices, 0.0)
        worth, last = knapsack(prices[open_], lengths[open_], capacity)
        bound = max(bound, float((counts * prices).sum() / worth[capacity]))
        around = prices + worth[capacity - lengths]
        good = np.flatnonzero(open_ & (around >= (1 - near) * worth[capacity]))
        good = good[np.argsort(covered[good], kind="stable")][:batch]
        for l in good.tolist():
            config = filled(last, capacity - int(lengths[l]))
            config[int(lengths[l])] = config.get(int(lengths[l]), 0) + 1
            at = place[list(config)]
            each = np.array(list(config.values()))
            times = min(max(volume, 1.0) / rounds / len(good), float(((1 - covered[at]) * counts[at] / each).min()))
            if times > 1e-12:
                covered[at] += each * times / counts[at]
                key = tuple(sorted(config.items()))
                chosen[key] = chosen.get(key, 0.0) + times
    out = []
    for key, times in chosen.items():
        config = np.zeros(len(lengths), np.int64)
        for size, each in key:
            config[place[size]] = each
        out.append((config, times))
    return out, bound


def best_fill(lengths: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
    """Pieces that fill `room` best, large ones rather than small: subset sums as bit sets, from the largest length down."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for l in range(int(np.searchsorted(lengths, room, "right")) - 1, -1, -1):
        size = int(lengths[l])
        for _ in range(min(int(left[l]), room // size)):
            more = (sums | sums << size) & mask
            if more == sums:
                break
            steps.append((l, size, sums))
            sums = more
        if sums >> room:
            break
    at, out = sums.bit_length() - 1, {}
    for l, size, before in reversed(steps):
        if not before >> at & 1:
            out[l] = out.get(l, 0) + 1
            at -= size
    return out


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, shares: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """A fractional solution rounded down, and best fit for what is left."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []

    def use(config: np.ndarray, most: int) -> None:
        some = config > 0
        times = min(most, int((left[some] // config[some]).min()))
        if times > 0:
            left[:] -= config * times
            out.append((config, times))

    for config, share in sorted(shares, key=lambda c: -c[1]):
        use(config, math.floor(share + 1e-9))
    largest = len(left) - 1
    while True:
        while largest >= 0 and not left[largest]:
            largest -= 1
        if largest < 0:
            return out
        config = np.zeros(len(lengths), np.int64)
        config[largest] = 1
        rest = left - config
        for l, n in best_fill(lengths, rest, capacity - int(lengths[largest])).items():
            config[l] += n
        use(config, int(left.max()))


def plan(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 64, batch: int = 32, near: float = 0.001, rate: float = 2.0, powers: tuple[float, ...] = (1.0, 1.25), gap: float = 0.002
) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Configurations (how many of each length) and how often each is used; together they use `counts` exactly. And the LP's lower bound on their number.

    The best of the solutions from several starting prices; the first within `gap` of the bound will do.
    """
    # few lengths need finer steps, and can have them
    rounds = max(rounds, min(8 * rounds, 128 * rounds // max(1, len(lengths))))
    best, bound = None, 0.0
    for power in powers:
        shares, least = fractional(lengths, counts, capacity, rounds, batch, near, rate, power)
        bound = max(bound, least)
        found = rounded(lengths, counts, capacity, shares)
        if best is None or sum(t for _, t in found) < sum(t for _, t in best):
            best = found
        if sum(t for _, t in best) <= (1 + gap) * bound + 1:
            break
    return best, bound


def assigned(rows: DataFrame, capacity: int = 2048, rounds: int = 64, order: str | None = None) -> DataFrame:
    """`rows` (any with column length, up to `capacity`) with sequence_id and a gapless offset.

    Pieces of one length are dealt to sequences in the order of column `order` (from 0 to 1, near to even), so that a sequence holds what lies near in it as far as
    lengths allow; without it, in that of a hash.
    """
    spark = rows.sparkSession
    columns = rows.columns
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()))
    whole, heavy = rows, [f.name for f in rows.schema.fields if isinstance(f.dataType, ArrayType)]
    rows = rows.drop(*heavy).withColumn("_order", F.col(order) if order else F.xxhash64("_row") / 2.0**64 + 0.5)
    histogram = sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())  # at most `capacity` rows
    lengths, counts = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    configs = plan(lengths, counts, capacity, rounds)[0] if histogram else []
    # ranges of ranks of each length: (first rank, sequences before, pieces a sequence, offset)
    next_rank, base = np.zeros(len(lengths), np.int64), 0
    ranges: list[tuple[int, int, int, int, int]] = []
    for config, times in configs:
        offset = 0
        for l in np.flatnonzero(config)[::-1]:
            ranges.append((int(l), int(next_rank[l]), base, int(config[l]), offset))
            next_rank[l] += config[l] * times
            offset += int(config[l] * lengths[l])
        base += times
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((lengths, table))

    # ranks within a length: salts part its pieces by their order, and counts of (length, salt) say where each salt starts; as many salts as each has rows
    salts_of = spark.createDataFrame([(n, math.isqrt(c - 1) + 1) for n, c in histogram] or [(0, 1)], "length long, _salts long")
    salt = F.least(F.greatest(F.floor(F.col("_order") * F.col("_salts")), F.lit(0)), F.col("_salts") - 1)
    salted = rows.join(F.broadcast(salts_of), "length").withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    own = Window.partitionBy("length", "_salt").orderBy("_order", "_row")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_own"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, table = shared.value
        big = np.int64(1) << 40
        keys = table[:, 0] * big + table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            length = batch.column("length").to_numpy()
            _, first, seq, each, offset = table[np.searchsorted(keys, np.searchsorted(lengths, length) * big + rank, "right") - 1].T
            more = {"sequence_id": seq + (rank - first) // each, "offset": offset + (rank - first) % each * length}
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, more.values())], [*names, *more])

    light = [c for c in columns if c not in heavy] + ["_row"] * bool(heavy)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in light) + ", sequence_id long, offset long"
    placed = ranked.select(*light, "_rank").mapInArrow(place, fields)
    # what is large joins last
    return placed.join(whole.select("_row", *heavy), "_row").select(*columns, "sequence_id", "offset") if heavy else placed


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False, rounds: int = 64, order: str | None = None) -> DataFrame:
    """Pieces of `docs` with their places: doc_id, (the column `order`,) piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return assigned(tokenized(docs, tokenizer_path, capacity, separator, with_ids, (order,) if order else ()), capacity, rounds, order)
