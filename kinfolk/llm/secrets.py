"""Secret scan by dictionary-primed zstandard novelty.

Fixed patterns find secrets that say what they are (`assign`, `access`, `hex`). Besides, each long unbroken string that stands within `context`
characters after a sensitive word is a candidate: it is compressed behind its surroundings with a dictionary of the corpus's own
identifiers, and reported as `novel` if it costs nearly as many marginal bytes as random strings of its length and alphabet do in the same place. A long candidate costs more
time, in proportion to its length.

The dictionary holds the commonest identifiers by exact counts over all documents, wherever they stand in the text; its size is bounded.
What stands only once in the corpus is not common: it would be a secret's own evidence.

Cases: a null or empty text has no spans; a null doc_id is kept; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Fixed patterns of the base scan, in the order in which kinds that start together are listed.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: An assignment needs one of these letters before the sign; texts without a sign are not searched for one.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
SENSITIVE = re.compile(r"key|secret|token|passw|credential|auth|bearer|private|signature|cookie", re.I | re.A)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,31}")
#: What may be an identifier: whole runs, as a part of a longer one is none.
RUN = re.compile(r"\w+")
KINDS = ("assign", "access", "hex", "novel")
#: Where a name is cut into parts, and what stands between the words of the surroundings.
CUT = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^A-Za-z0-9]+")
BETWEEN = re.compile(r"\W+")
#: Beginnings of the surroundings that are tried, random strings drawn for each, and the share of their cost from which a string is reported.
CUTS, DRAWS, LEAST = 8, 3, 0.87
#: Distinct words counted before a worker hands its counts on.
COUNTED = 200_000


def identifier_dictionary(docs: DataFrame, max_bytes: int = 1 << 16) -> bytes:
    """The commonest identifiers of the corpus, commonest last (zstandard finds near matches cheapest), `max_bytes` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            counts = [(w, n) for w, n in seen.items() if IDENTIFIER.fullmatch(w)]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int64())], ["word", "n"])

        for _, texts in pieces(batches):
            for t in texts:
                seen.update(RUN.findall(t))
            if len(seen) >= COUNTED:
                yield told()
                seen.clear()
        yield told()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(max_bytes // 4)
    size, words = 0, []
    for r in top.toLocalIterator():
        size += len(r.word) + 1
        if size > max_bytes:
            break
        words.append(r.word)
    return "\n".join(reversed(words)).encode()


def parts(string: str) -> str:
    """The words of a name or path, a line each, in small letters: cut at marks, before capitals and between letters and digits."""
    return "\n" + CUT.sub("\n", string).lower() + "\n"


def alphabet(string: str) -> str:
    """What a random string like this one is drawn from: whole sets of small letters, capitals and digits where it has any, and its own marks."""
    sets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    return "".join(s for s in sets if set(s) & set(string)) + "".join(sorted(c for c in set(string) if not c.isalnum()))


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings and a dictionary, against those of random strings of its length and alphabet.

    Strings, surroundings and dictionary are compared by their parts in small letters, so that a name made of known words is cheap however it is written.
    """

    def __init__(self, dictionary: bytes, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level)
        words = dict.fromkeys(reversed(dictionary.decode().lower().split("\n")))
        primed = ("\n".join(reversed(words)) + "\n").encode()
        if len(primed) >= 8:
            held = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.compressor = zstandard.ZstdCompressor(level=level, dict_data=held)

    def _bytes(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def relative(self, around: str, string: str) -> float:
        """1 for a string that costs what random ones do, less for one that its surroundings or the dictionary explain. Sums over CUTS beginnings of the surroundings level the steps of whole bytes."""
        before = "\n" + BETWEEN.sub("\n", around).lower()
        letters, draw = alphabet(string), random.Random(f"{len(string)} {string[:1]}")
        own = drawn = 0
        for k in range(CUTS):
            held = before[len(before) * k // (2 * CUTS) :]
            alone = self._bytes(held)
            own += DRAWS * (self._bytes(held + parts(string)) - alone)
            drawn += sum(self._bytes(held + parts("".join(draw.choices(letters, k=len(string))))) - alone for _ in range(DRAWS))
        return own / max(1, drawn)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def novel_spans(text: str, found: list[tuple[int, int, str]], novelty: Novelty, context: int, least: float) -> list[tuple[int, int, str]]:
    """Candidates in sensitive context, not inside a base span, that cost at least `least` of what random strings like them do."""
    out = []
    words = [m.start() for m in SENSITIVE.finditer(text)]
    if not words:
        return out
    at = 0
    for m in CANDIDATE.finditer(text, words[0]):
        while at + 1 < len(words) and words[at + 1] < m.start():
            at += 1
        if not 0 < m.start() - words[at] <= context or any(a < m.end() and m.start() < b for a, b, _ in found):
            continue
        before, after = text[max(0, m.start() - 4 * context) : m.start()], text[m.end() : m.end() + 4 * context]
        if novelty.relative(after + before, m[0]) >= least:
            out.append((m.start(), m.end(), "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, context: int = 64, least: float = LEAST, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, redacted (the text with each span replaced, null if it has none)."""
    spark = docs.sparkSession
    primed = spark.sparkContext.broadcast(identifier_dictionary(docs) if dictionary is None else dictionary)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed.value)
        names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "redacted"]
        types = [pa.int64()] * 4 + [pa.string()] * 3
        for part, texts in pieces(batches):
            rows: list[list] = [[] for _ in names]
            for text in texts:
                base = base_spans(text)
                spans = base + novel_spans(text, base, novelty, context, least)
                kinds = Counter(s[2] for s in spans)
                values = [*(kinds[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if spans else None]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with each stretch of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind} removed>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, context: int = 64, least: float = LEAST, dictionary: bytes | None = None) -> DataFrame:
    """`docs` with secrets taken out of `text` (and n_chars, if there, counted anew); all other columns as they are."""
    spark = docs.sparkSession
    primed = spark.sparkContext.broadcast(identifier_dictionary(docs) if dictionary is None else dictionary)
    columns = docs.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed.value)
        for part, texts in pieces(batches):
            originals = part.column("text").to_pylist()
            for i, text in enumerate(texts):
                base = base_spans(text)
                if spans := base + novel_spans(text, base, novelty, context, least):
                    originals[i] = redact(text, spans)
            arrays = [pa.array(originals, pa.string()) if c == "text" else part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    out = docs.mapInArrow(cleaned, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns) if "n_chars" in columns else out
