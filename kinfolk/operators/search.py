"""Searches over frames of edges (src, dst) that hold both directions of each edge, once, and no loops. Loops write each level to the shared folder.

Many sources are searched together by masks: a row (block, node, mask) says which of a block's MASK_BITS sources have come to the node, so a level of a block is one row a
node. Edges go both ways, so what a level's nodes see lies in the level before, their own or the next: two levels are all that is held against.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import within
from .graph import components, save

#: Sources that a row's mask stands for, and rows (block of sources, node) that one pass over the sources may hold.
MASK_BITS, PASS_ROWS = 63, 1 << 30
#: Nodes aimed at in a bucket of `numbered`.
BUCKET_NODES = 1000


@dataclass
class Work:
    """What a search had to do, counted if one is handed in."""

    rounds: int = 0
    rows: int = 0
    searched: int = 0


def numbered(nodes: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, bit and the columns of `nodes` (distinct person): blocks of at most MASK_BITS nodes. Hashing deals the nodes to buckets, so that no task ranks them all."""
    dealt = nodes.withColumn("bucket", F.pmod(F.xxhash64("person"), F.lit(buckets)))
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("person")) - 1)
    return dealt.withColumn("block", F.col("bucket") * 1_000_000 + F.expr(f"place div {MASK_BITS}")).withColumn("bit", (F.col("place") % MASK_BITS).cast("int")).drop("place")


def _front(sources: DataFrame) -> DataFrame:
    return save(sources.select("block", F.col("person").alias("node"), F.expr("shiftleft(1L, bit)").alias("mask")))


def _next(edges: DataFrame, front: DataFrame, last: DataFrame) -> DataFrame:
    """The next level's rows: who comes to a node that came to it neither in this level nor in the one before. Both levels go through the shuffle that gathers the masks."""
    none = F.lit(0).cast("long")
    near = front.join(edges, front.node == edges.src).select("block", F.col("dst").alias("node"), "mask", none.alias("known"))
    for old in (front, last):
        near = near.unionAll(old.select("block", "node", none.alias("mask"), F.col("mask").alias("known")))
    fresh = near.groupBy("block", "node").agg(F.expr("bit_or(mask) & ~bit_or(known)").alias("mask"))
    return save(fresh.where("mask <> 0"))


#: Of a block's masks, how many hold each bit.
_BITS = "array(" + ", ".join(f"sum(shiftright(mask, {b}) & 1L)" for b in range(MASK_BITS)) + ")"


def _counts(front: DataFrame, sources: DataFrame) -> DataFrame:
    """person, c: nodes that each source has come to in this level; sources without any are left out."""
    each = front.groupBy("block").agg(F.expr(_BITS).alias("bits")).select("block", F.posexplode("bits").alias("bit", "c")).where("c > 0")
    return sources.join(each, ["block", "bit"]).select("person", "c")


def _passes(sources: DataFrame, n: int, pass_rows: int) -> Iterator[DataFrame]:
    """`sources`, numbered, in parts whose levels have at most `pass_rows` rows, if the graph has n nodes."""
    m = sources.count()
    buckets = max(1, -(-m // BUCKET_NODES))
    whole = save(numbered(sources, buckets))
    blocks = whole.select("bucket", "block").distinct().count()
    passes = min(buckets, max(1, -(-blocks * n // pass_rows)))
    for i in range(passes):
        yield whole if passes == 1 else whole.where(F.col("bucket") % passes == i)


def levels(edges: DataFrame, sources: DataFrame, n: int, depth: int | None = None, pass_rows: int = PASS_ROWS) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(level, sources, front) for each level from 0 of each pass over `sources` (distinct person) of a graph of n nodes: the numbered sources and the level's masks."""
    edges = save(edges.select("src", "dst"))
    for mine in _passes(sources, n, pass_rows):
        front = last = _front(mine)
        level = 0
        while not front.isEmpty():
            yield level, mine, front
            if level == depth:
                break
            level += 1
            last, front = front, _next(edges, front, last)


def level_counts(edges: DataFrame, nodes: DataFrame, sources: DataFrame, depth: int | None = None, pass_rows: int = PASS_ROWS, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """person, level, c: how many of `nodes` (person) lie at each distance from each of `sources` (person), up to `depth`; level 0 is the source itself. No rows of pairs are made.

    Components of at most `task_edges` edges are searched inside tasks (`within`), larger ones by joins of masks, of at most `pass_rows` rows a level.
    """
    sources = save(sources.select("person").distinct())
    out = sources.select("person", F.lit(0).alias("level"), F.lit(1).cast("long").alias("c"))
    dealt = within.placed(edges, nodes, sources, task_edges)
    every = dealt.sources.count() == dealt.edges.select("src").distinct().count()
    inner = save(within.counted(dealt, own=not every, met=every, depth=depth))
    out = out.unionByName(inner.groupBy("person", "level").agg(F.sum("c").alias("c")))
    if dealt.large:
        wide, some = dealt.large
        for level, mine, front in levels(wide, some, nodes.count(), depth, pass_rows):
            if level:
                out = out.unionByName(save(_counts(front, mine)).select("person", F.lit(level).alias("level"), F.col("c").cast("long").alias("c")))
    return out


def both_sums(edges: DataFrame, nodes: DataFrame, sources: DataFrame, pass_rows: int = PASS_ROWS, task_edges: int = within.TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Of one search from `sources` (person): their own sums (person, s), and for each node that they reach, how many do and the sum of its distances to them (person, n, s)."""
    sources = save(sources.select("person").distinct())
    dealt = within.placed(edges, nodes, sources, task_edges)
    inner = save(within.counted(dealt, own=True, met=True))
    far = (F.col("c") * F.col("level")).alias("s")
    own = sources.select("person", F.lit(0).cast("long").alias("s")).unionByName(inner.where("own").select("person", far))
    met = sources.select("person", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("s")).unionByName(inner.where("NOT own").select("person", F.col("c").alias("n"), far))
    if dealt.large:
        wide, some = dealt.large
        for level, mine, front in levels(wide, some, nodes.count(), pass_rows=pass_rows):
            if level:
                own = own.unionByName(save(_counts(front, mine)).select("person", (F.col("c") * level).cast("long").alias("s")))
                here = front.groupBy(F.col("node").alias("person")).agg(F.sum(F.bit_count("mask")).alias("n"), F.sum(F.bit_count("mask") * level).alias("s"))
                met = save(met.unionByName(here).groupBy("person").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    return own.groupBy("person").agg(F.sum("s").alias("s")), met.groupBy("person").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def sums_of(levels: DataFrame) -> DataFrame:
    """person, r (nodes reached, itself included), s (sum of the distances to them)."""
    return levels.groupBy("person").agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("level")).alias("s"))


def bounded_sums(edges: DataFrame, sources: DataFrame, n: int, pass_rows: int = PASS_ROWS) -> DataFrame:
    """person, r, s: distance sums of those `sources` (person, r: nodes it reaches, most: the largest sum of interest or null) whose sum is at most `most`.

    What a source has not seen by a level lies further, which bounds its sum from below; a source whose bound passes `most` is searched no further.
    """
    whole = None
    for mine in _passes(sources, n, pass_rows):
        state = mine.select("*", F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("seen"))
        front = last = whole_front = _front(mine)
        level = 0
        while True:
            level += 1
            last, front = whole_front, _next(edges, front, last)
            if front.isEmpty():
                break
            whole_front = front
            now = state.join(_counts(front, mine), "person", "left").withColumn("c", F.coalesce("c", F.lit(0)))
            now = now.withColumn("s", F.col("s") + F.col("c") * level).withColumn("seen", F.col("seen") + F.col("c")).drop("c")
            least = F.col("s") + (F.col("r") - F.col("seen")) * (level + 1)
            now = save(now.withColumn("out", F.coalesce(least > F.col("most"), F.lit(False))))
            done = now.where(F.col("out") | (F.col("seen") >= F.col("r"))).groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("gone"))
            state = now.where("NOT out").drop("out")
            front = front.join(done, "block", "left").select("block", "node", F.expr("mask & ~coalesce(gone, 0L)").alias("mask")).where("mask <> 0")
        part = save(state.select("person", F.col("seen").alias("r"), "s"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def walk_counts(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """person, walks: for each distance from 1 to `depth` an upper bound of the nodes at it: the walks of so many edges that never turn straight back, of which every shortest
    path is one. They follow from the neighbours' counts, one join a level: walks(l) = sum of the neighbours' walks(l - 1) - (degree - 1) walks(l - 2). Null where the count passes 2^52."""
    edges = save(edges.select("src", "dst"))
    degree = edges.groupBy(F.col("src").alias("person")).agg(F.count("*").alias("degree"))
    state = save(nodes.select("person").distinct().join(degree, "person", "left").select("person", F.coalesce("degree", F.lit(0)).alias("degree"), F.array(F.coalesce("degree", F.lit(0))).alias("walks")))
    for level in range(2, depth + 1):
        there = state.select(F.col("person").alias("dst"), F.element_at("walks", level - 1).alias("w"))
        near = edges.join(there, "dst").groupBy(F.col("src").alias("person")).agg(F.when(F.count("*") == F.count("w"), F.try_sum("w")).alias("total"), F.lit(True).alias("has"))
        back = F.col("degree") if level == 2 else (F.col("degree") - 1) * F.element_at("walks", level - 2)
        total = F.when(F.col("has"), F.col("total")).otherwise(F.lit(0)) - F.when(F.col("has"), back).otherwise(F.lit(0))
        state = save(state.join(near, "person", "left").select("person", "degree", F.concat("walks", F.array(F.when(total < (1 << 52), total))).alias("walks")))
    return state


def least_sum(r: Column, walks: Column) -> Column:
    """A lower bound of the distance sum of a node that reaches r nodes (itself included): the r - 1 others at the smallest distances that the bounds of `walks` allow."""
    start = F.struct((r - 1).cast("long").alias("rest"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("level"))

    def fill(a: Column, w: Column) -> Column:
        level, taken = a["level"] + 1, F.least(F.coalesce(w, a["rest"]), a["rest"])
        return F.struct((a["rest"] - taken).alias("rest"), (a["s"] + taken * level).alias("s"), level.alias("level"))

    return F.aggregate(walks, start, fill, lambda a: a["s"] + a["rest"] * (a["level"] + 1))


def meet(edges: DataFrame, pairs: DataFrame, work: Work | None = None, saved: bool = False) -> DataFrame:
    """query_no, distance (-1: none) of each of `pairs` (query_no, p1, p2, x, h): searched from both ends, a pair's smaller frontier going one level on in each round.

    edges: src, dst, reply_min; a pair's paths use edges with reply_min > x, all if x < 0. With h not null, distances above h count as none. The frontiers of a pair that
    has met, that has nowhere to go, or whose levels add up to h are given up. `saved`: the edges are read from a file, and need not be written again.
    """
    edges = edges if saved else save(edges.select("src", "dst", "reply_min"))
    pairs = save(pairs.select("query_no", "p1", "p2", "x", "h"))
    out = pairs.where("p1 = p2").select("query_no", F.lit(0).alias("distance"))
    live = save(pairs.where("p1 <> p2 AND coalesce(h, 1) > 0").select("query_no", "x", "h", F.lit(1).cast("long").alias("size_a"), F.lit(1).cast("long").alias("size_b"), F.lit(0).alias("levels")))
    ends = pairs.where("p1 <> p2").select("query_no", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("p1").alias("node")), F.struct(F.lit("b").alias("side"), F.col("p2").alias("node")))).alias("e"))
    state = save(ends.select("query_no", "e.side", "e.node", F.lit(0).alias("age")))
    while not live.isEmpty():
        turn = live.select("query_no", "x", F.when(F.col("size_a") <= F.col("size_b"), "a").otherwise("b").alias("turn"))
        held = state.join(turn, "query_no")
        moving, resting = held.where("side = turn"), held.where("side <> turn")
        steps = moving.where("age = 0").join(edges, moving.node == edges.src).where("x < 0 OR reply_min > x").select("query_no", "side", F.col("dst").alias("node"), F.lit(False).alias("known"))
        fresh = steps.unionAll(moving.select("query_no", "side", "node", F.lit(True))).groupBy("query_no", "side", "node").agg(F.bool_or("known").alias("known")).where("NOT known")
        columns = ["query_no", "side", "node", "age"]
        state = save(fresh.select("query_no", "side", "node", F.lit(0).alias("age")).unionAll(moving.where("age = 0").withColumn("age", F.lit(1)).select(columns)).unionAll(resting.select(columns)))
        edge = state.where("age = 0")
        at = edge.groupBy("query_no", "node").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
        sizes = at.groupBy("query_no").agg(F.sum("a").alias("size_a"), F.sum("b").alias("size_b"), F.bool_or((F.col("a") > 0) & (F.col("b") > 0)).alias("met"))
        now = live.select("query_no", "x", "h", (F.col("levels") + 1).alias("levels")).join(sizes, "query_no")
        now = save(now)
        out = out.unionByName(now.where("met").select("query_no", F.col("levels").alias("distance")))
        live = now.where("NOT met AND size_a > 0 AND size_b > 0 AND (h IS NULL OR levels < h)").drop("met")
        if work is not None:
            work.rounds += 1
            work.rows += edge.count()
    found = save(out)
    return pairs.select("query_no").join(found, "query_no", "left").select("query_no", F.coalesce("distance", F.lit(-1)).cast("int").alias("distance"))


def path_nodes(edges: DataFrame, pairs: DataFrame, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """query_no, step (from 0 at p1), person along one shortest path of each of `pairs` (query_no, p1, p2): backwards from p2, the smallest node one step nearer to p1. No rows where there is no path.

    Pairs of two components are left out first. Components of at most `task_edges` edges are searched and traced inside tasks, those of larger ones by joins.
    """
    edges = save(edges.select("src", "dst"))
    pairs = save(pairs.select("query_no", "p1", "p2"))
    same = pairs.where("p1 = p2").select("query_no", F.lit(0).alias("step"), F.col("p1").alias("person"))
    comps = save(components(edges, edges.select(F.col("src").alias("person")).distinct()))
    ends = [comps.select(F.col("node").alias(p), F.col("comp").alias(f"comp_{p}")) for p in ("p1", "p2")]
    joined = pairs.where("p1 <> p2").join(ends[0], "p1").join(ends[1], "p2").where("comp_p1 = comp_p2")
    sources = save(joined.select(F.col("p1").alias("person"), "query_no", F.col("p2").alias("target")))
    dealt = within.placed(edges, sources.select("person"), sources, task_edges, comps)
    out = same.unionByName(within.traced(dealt))
    if dealt.large:
        wide, some = dealt.large
        out = out.unionByName(_path_nodes(wide, some.select("query_no", F.col("person").alias("p1"), F.col("target").alias("p2"))))
    return out


def _path_nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`path_nodes` by joins: one loop reaches out from all sources and keeps each node's smallest predecessor, a second one, level by level, traces the pairs back."""
    edges = save(edges.select("src", "dst"))
    pairs = save(pairs.select("query_no", "p1", "p2"))
    front = save(pairs.select(F.col("p1").alias("source"), F.col("p1").alias("node"), F.lit(None).cast("long").alias("before")).distinct())
    wanted = save(pairs.select(F.col("p1").alias("source"), F.col("p2").alias("node")).distinct())
    levels = [front]
    last = front
    while True:
        wanted = save(wanted.join(levels[-1], ["source", "node"], "left_anti"))
        active = levels[-1].join(wanted.select("source").distinct(), "source", "left_semi")
        near = active.join(edges, active.node == edges.src).groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("before"))
        fresh = save(near.join(levels[-1], ["source", "node"], "left_anti").join(last, ["source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        last = levels[-1]
        levels.append(fresh)
    steps, waiting = [], pairs.select("query_no", F.col("p1").alias("source"), F.col("p2").alias("node"))
    for level in range(len(levels) - 1, -1, -1):
        # a pair is at this level if its path comes through it or ends in it; others wait for a level further in
        at = save(waiting.join(levels[level].withColumn("here", F.lit(True)), ["source", "node"], "left"))
        steps.append(at.where("here").select("query_no", F.lit(level).alias("step"), F.col("node").alias("person")))
        waiting = at.select("query_no", "source", F.when(F.col("here"), F.col("before")).otherwise(F.col("node")).alias("node"))
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out


def hop_counts(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """person, h1, h2, ...: how many of `nodes` (person) lie within each number of hops up to `hops`, the person not counted.

    A ball is a set of bitmaps, one for each bucket of 32,768 ids it holds; a ball one hop wider is the union of the neighbours' balls, so nothing is counted twice and no rows of pairs are made.
    """
    edges = save(edges.select("src", "dst"))
    alone = F.bitmap_construct_agg(F.bitmap_bit_position("person"))
    ball = save(nodes.select("person").distinct().groupBy("person", F.bitmap_bucket_number("person").alias("bucket")).agg(alone.alias("bits")))
    out = ball.select("person")
    for h in range(1, hops + 1):
        wider = edges.join(ball.withColumnRenamed("person", "dst"), "dst").select(F.col("src").alias("person"), "bucket", "bits").unionByName(ball)
        ball = save(wider.groupBy("person", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        out = save(out.join(ball.groupBy("person").agg((F.sum(F.bitmap_count("bits")) - 1).alias(f"h{h}")), "person"))
    return out
