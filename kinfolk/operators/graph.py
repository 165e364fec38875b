"""Graph operators over frames of edges (src, dst). Loops write each level to the shared folder, which cuts their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}
#: Nodes that `contracted` remembers before it hands on what it has.
FOREST_NODES = 1 << 20


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
    path = f"{scratch_dir(df.sparkSession)}/kinfolk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reply_counts(replies: DataFrame) -> DataFrame:
    """src, dst, n: replies of src to dst, without those to oneself."""
    return replies.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def reply_weights(knows: DataFrame, replies: DataFrame) -> DataFrame:
    """src, dst, reply_min: for each edge the smaller of the two directions' reply counts. Only replies between friends are counted."""
    counts = save(reply_counts(replies.join(knows, ["src", "dst"], "left_semi")))
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("m"))
    weighed = knows.join(counts, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    return weighed.select("src", "dst", F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("reply_min"))


def replies_between(replies: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_no, forth, back: how often p1 of each of `pairs` (query_no, p1, p2) replied to p2, and p2 to p1. Only the pairs' replies are counted."""
    ends = pairs.select("query_no", F.col("p1").alias("src"), F.col("p2").alias("dst"))
    both = ends.withColumn("forth", F.lit(1)).unionByName(ends.select("query_no", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("forth")))
    counts = reply_counts(replies.join(both.select("src", "dst").distinct(), ["src", "dst"], "left_semi"))
    found = both.join(counts, ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.groupBy("query_no").agg(F.sum(F.col("n") * F.col("forth")).alias("forth"), F.sum(F.col("n") * (1 - F.col("forth"))).alias("back"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in `nodes` (person)."""
    return edges.join(nodes.select(F.col("person").alias("src")), "src", "left_semi").join(nodes.select(F.col("person").alias("dst")), "dst", "left_semi").select("src", "dst")


def reach(edges: DataFrame, sources: DataFrame, hops: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """source, node, dist within `hops` (or all) of each of `sources` (person), itself included: one level-synchronous loop for all sources.

    Edges go both ways, so what a level's nodes see lies in the level before, their own or the next: only two levels are held against. `wanted`
    (source, node): sources with all of their wanted nodes reached go no further.
    """
    edges = save(edges)
    frontier = save(sources.select(F.col("person").alias("source"), F.col("person").alias("node"), F.lit(0).alias("dist")).distinct())
    seen, last, level = frontier, frontier, 0
    while hops is None or level < hops:
        level += 1
        active = frontier
        if wanted is not None:
            wanted = save(wanted.join(frontier, ["source", "node"], "left_anti"))
            active = active.join(wanted.select("source").distinct(), "source", "left_semi")
        near = active.join(edges, active.node == edges.src).select("source", F.col("dst").alias("node"), F.lit(False).alias("known"))
        for old in (frontier, last):  # they go through the shuffle that makes the new rows distinct
            near = near.unionAll(old.select("source", "node", F.lit(True)))
        fresh = near.groupBy("source", "node").agg(F.bool_or("known").alias("known")).where("NOT known")
        last, frontier = frontier, save(fresh.select("source", "node", F.lit(level).alias("dist")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def contracted(edges: DataFrame, keys: tuple[str, ...] = (), nodes: int = FOREST_NODES) -> DataFrame:
    """(*keys,) src, dst, both ways: stars that join the same nodes as `edges` do, from edges joined within each task.

    With keys, a graph's edges come together, large graphs in several parts. A task that has met `nodes` nodes emits its stars and starts anew, so its memory is bounded;
    what it could not join is left to the caller.
    """
    names = [*keys, "src", "dst"]
    once = edges.where("src < dst").select(*names)
    if keys:
        once = once.hint("rebalance", *keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        def stars() -> pa.RecordBatch:
            rows = [(*x[:-1], x[-1], r[-1]) for x in above if (r := root(x)) != x]
            rows += [(*k, b, a) for *k, a, b in rows]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or batch.schema
            *of, a, b = (column.to_pylist() for column in batch.columns)
            for *key, x, y in zip(*of, a, b, strict=True):
                x, y = (*key, x), (*key, y)
                x, y = root(above.setdefault(x, x)), root(above.setdefault(y, y))
                if x != y:
                    above[max(x, y)] = min(x, y)
                if len(above) >= nodes:
                    yield stars()
                    above.clear()
        if above:
            yield stars()

    return once.mapInArrow(join, once.schema)


def thinned(edges: DataFrame, keys: tuple[str, ...] = (), nodes: int = FOREST_NODES) -> DataFrame:
    """Of `edges` (*keys, src, dst, weight; each once) enough to join, at every weight, what all edges of that weight or more join: spanning forests of the largest weights.

    Each task reads its edges from the largest weight down and leaves out those whose ends it has already joined. A graph in one task becomes a forest; a large one lies in
    several, and a task that has met `nodes` nodes forgets them, so that some more edges stay.
    """
    names = [*keys, "src", "dst", "weight"]
    placed = edges.select(*names)
    if keys:
        placed = placed.hint("rebalance", *keys)

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            *of, a, b = (column.to_pylist() for column in batch.columns[:-1])
            kept = []
            for i, (*key, x, y) in enumerate(zip(*of, a, b, strict=True)):
                x, y = (*key, x), (*key, y)
                x, y = root(above.setdefault(x, x)), root(above.setdefault(y, y))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    kept.append(i)
                if len(above) >= nodes:
                    above.clear()
            yield batch.take(pa.array(kept, pa.int64()))

    return placed.sortWithinPartitions(*keys, F.desc("weight"), "src", "dst").mapInArrow(joining, placed.schema)


def components(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys,) node, comp: the smallest node each one reaches. With `keys`, one graph for each value of these columns, all in a single loop.

    Tasks first join what edges they hold to stars, of which there are fewer; the loop then has little to do.
    """
    edges = save(contracted(edges, keys))
    labels = save(nodes.select(*keys, F.col("person").alias("node"), F.col("person").alias("comp")).distinct())
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, "src").agg(F.min("comp").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "node"), [*keys, "node"], "left").select(*keys, "node", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        far = labels.select(*keys, F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = save(hooked.join(far, [*keys, "next"], "left").select(*keys, "node", "old", F.least("next", "far").alias("comp")))
        if moved.where("comp <> old").isEmpty():
            return moved.select(*keys, "node", "comp")
        labels = moved.select(*keys, "node", "comp")


def place_closure(place: DataFrame, part_of: DataFrame) -> DataFrame:
    """ancestor, descendant: every place with itself and all places inside it."""
    seen = save(place.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant")).distinct())
    frontier = seen
    while True:
        deeper = frontier.join(part_of, frontier.descendant == part_of.parent).select("ancestor", F.col("child").alias("descendant")).distinct()
        frontier = save(deeper.join(seen, ["ancestor", "descendant"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def common_interests(pairs: DataFrame, interest: DataFrame) -> DataFrame:
    """a, b, common: shared tags of each pair, 0 included."""
    of = interest.distinct()
    shared = pairs.join(of.select(F.col("person").alias("a"), "tag"), "a").join(of.select(F.col("person").alias("b"), "tag"), ["b", "tag"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


def two_hop_neighbours(edges: DataFrame) -> DataFrame:
    """person, other: exactly two hops apart."""
    e = edges.select("src", "dst")
    two = e.alias("x").join(e.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).where("src <> dst").distinct()
    return two.join(e, ["src", "dst"], "left_anti").select(F.col("src").alias("person"), F.col("dst").alias("other"))
