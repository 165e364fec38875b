"""What the operators share: the shared scratch folder, small-batch reading of Arrow input, word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works through an Arrow batch in pieces of about so many characters, so that its word lists stay small.
PIECE_CHARS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a temporary one, if driver and executors are one process; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        folder = _own.get(context.applicationId) or _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='kinfolk-')}")
    return folder.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kinfolk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Frames:
    """Saved frames of one operator that go when it is done; what it returns is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Frames:
        return self

    def save(self, df: DataFrame) -> DataFrame:
        saved, path = _written(df)
        self.paths.append(path)
        return saved

    def keep(self, df: DataFrame) -> DataFrame:
        return save(df)

    def __exit__(self, *_) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession, rows: int = 0, per_partition: int = 1) -> int:
    """Partitions for an explicit repartition: the session's number, or more where the rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: a worker waits for its next task for as long as the application lasts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), about PIECE_CHARS each. Memory that a task's batches took is given back at their end."""
    for batch in batches:
        column = batch.column(text)
        start, size = 0, 0
        lengths = [n or 0 for n in pc.binary_length(column).to_pylist()]
        for i, n in enumerate(lengths):
            size += n
            if size >= PIECE_CHARS or i + 1 == len(lengths):
                part = batch.slice(start, i + 1 - start)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                start, size = i + 1, 0
                del part
    give_back()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, end to end, and where each text starts and ends."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    hash_of = xxhash.xxh3_64_intdigest
    return np.fromiter((hash_of(w) for ws in words for w in ws), np.uint64, bounds[-1]), bounds


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo `folds`; a null id counts as fold 0 (held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))
