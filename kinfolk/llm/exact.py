"""Exact duplicates by a persistent index of text digests; DataFrame functions and SQL only.

Texts are equal when they are identical after deleting every character of `[\\x20\\x09-\\x0D]`; their digest is the SHA-256 of what is left, in UTF-8. The index is a
Parquet table in a folder of its own, bucketed and sorted by digest, with one row a digest. A batch of new rows is summed to one row a digest, anti-joined with the
index by a merge of sorted buckets (the index is not shuffled), and what is new is appended. Of a batch's equal rows the one with the most code points, then the
smallest id, goes into the index; a text that an earlier batch brought keeps the row it has. A batch has a name: adding it again (after a failure, say) changes
nothing and gives the same decisions.

A group of copies may hold most rows: the sums before the shuffle leave one row a task, and the at most HOT groups that hold a HOT-th of a batch or more find their rows
by broadcast.

Cases: a null text counts as empty, so all texts without other characters than those deleted are one group; null ids come after all others; of rows with equal id and
length (repeated rows) one is kept; an empty batch adds nothing and gives no rows; columns other than `doc_id` and `text` are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, shuffle_partitions

#: Broadcast groups hold at least a HOT-th of a batch's rows each, so there are at most so many.
HOT = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


class DigestIndex:
    """The index in `folder` (a path that driver and executors share): opened if it is there, else made with so many buckets and this type of ids."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, id_type: str = "bigint"):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = f"{self.folder}/about"
        path = spark._jvm.org.apache.hadoop.fs.Path(about)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            kept = json.loads(spark.read.text(about).first()[0])
            buckets, id_type = kept["buckets"], kept["id_type"]
        else:
            spark.createDataFrame([(json.dumps({"buckets": buckets, "id_type": id_type}),)], "value string").coalesce(1).write.text(about)
        self.buckets, self.id_type = buckets, id_type
        self.name = f"kinfolk_digests_{hashlib.md5(self.folder.encode()).hexdigest()}"
        self._register()

    def _register(self) -> None:
        columns = f"digest STRING, keep_id {self.id_type}, keep_length BIGINT, batch STRING"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/digests'")

    def table(self) -> DataFrame:
        """digest, keep_id, keep_length, batch: a row for each text."""
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of `groups` (with column digest) whose digests the index does not hold."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def _append(self, entries: DataFrame) -> None:
        """Each bucket's rows come to one task, which writes them sorted as one file."""
        entries.select("digest", "keep_id", "keep_length", "batch").repartition(self.buckets, "digest").write.mode("append").insertInto(self.name)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Decisions on the rows of `docs` (doc_id, text): doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256. The new texts are in the index afterwards."""
        rows = docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias("row"))
        rows = save(rows)  # `row` stands from here on
        first = F.min(F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        groups = save(rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")))
        entries = self.unseen(groups).select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.shorter")).alias("keep_length"), F.lit(batch).alias("batch"))
        self._append(entries)
        mine = F.when(F.col("batch") == batch, F.col("first.row"))
        decided = save(groups.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", mine.alias("keep_row")))
        total = rows.count()
        hot = F.broadcast(decided.where(F.col("group_size") * HOT >= total))
        cold = decided.where(F.col("group_size") * HOT < total)
        found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
        return found.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))

    def compact(self) -> DigestIndex:
        """The same index in a new folder beside this one, one sorted file a bucket again: many appends leave many files."""
        fresh = DigestIndex(self.spark, f"{self.folder}-compact", self.buckets, self.id_type)
        fresh._append(self.table().join(fresh.table().select("digest"), "digest", "left_anti"))
        return fresh


def deduplicated(docs: DataFrame, folder: str) -> DataFrame:
    """One row for each row of `docs`, by a fresh index in `folder`."""
    spark = docs.sparkSession
    index = DigestIndex(spark, folder, shuffle_partitions(spark), docs.schema["doc_id"].dataType.simpleString())
    return index.add(docs, "whole")
