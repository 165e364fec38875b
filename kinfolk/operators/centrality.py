"""Sums of distances, what follows from them, and the most central nodes by bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import within
from .graph import components, reach, save
from .search import PASS_ROWS, Work, both_sums, bounded_sums, least_sum, level_counts, sums_of, walk_counts


def distance_sums(edges: DataFrame, nodes: DataFrame, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """person, r (nodes reached, itself included), s (sum of the distances to them) within the graph of `nodes` (person).

    Components of at most `task_edges` edges are searched inside tasks, larger ones by joins of masks (`search.level_counts`).
    """
    return sums_of(level_counts(edges, nodes, nodes, task_edges=task_edges))


def masked_sums(edges: DataFrame, nodes: DataFrame, pass_rows: int = PASS_ROWS) -> DataFrame:
    """As `distance_sums`, with at most `pass_rows` rows of masks in a level of a large component."""
    return sums_of(level_counts(edges, nodes, nodes, pass_rows=pass_rows))


def closeness(r: Column, s: Column, n: Column) -> Column:
    """(r - 1)^2 / ((n - 1) s), 0 if nothing else is reached."""
    reached = (r - 1).cast("double") * (r - 1)
    return F.when((s > 0) & (n > 1), reached / ((n - 1).cast("double") * s)).otherwise(F.lit(0.0))


def sum_limit(r: Column, n: Column, least: Column) -> Column:
    """The largest distance sum with which a node that reaches r nodes is no less central than `least`; null if `least` is null or 0, or r is 1."""
    reached = (r - 1).cast("double") * (r - 1)
    return F.when((least > 0) & (r > 1), F.floor(reached / ((n - 1).cast("double") * least) * (1 + 1e-12)))


def most_central(edges: DataFrame, nodes: DataFrame, k: int, depth: int = 6, block: int = 504, work: Work | None = None) -> DataFrame:
    """person, centrality of the k most central of `nodes` (person), by centrality, then id, without searching from all of them.

    A node's sum is bounded from below by walks that do not turn back (`search.walk_counts`), so its centrality from above. Rounds search from the block of nodes with
    the highest bounds, each only as far as its sum may still be small enough for the k-th place so far, and end when no bound left reaches that place.
    """
    edges, nodes = save(edges.select("src", "dst")), save(nodes.select("person").distinct())
    n = nodes.count()
    parts = save(components(edges, nodes))
    sizes = parts.groupBy("comp").agg(F.count("*").alias("r"))
    of = parts.join(sizes, "comp").select(F.col("node").alias("person"), "r")
    bounded = of.join(walk_counts(edges, nodes, depth), "person").select("person", "r", least_sum(F.col("r"), F.col("walks")).alias("least"))
    waiting = save(bounded.select("person", "r", closeness(F.col("r"), F.col("least"), F.lit(n)).alias("bound")))
    best = save(nodes.where("false").select("person", F.lit(0.0).alias("centrality")))
    place, least = None, None  # where in the order of bounds the search has come to; the k-th centrality so far
    while True:
        left = waiting if place is None else waiting.where((F.col("bound") < place.bound) | ((F.col("bound") == place.bound) & (F.col("person") > place.person)))
        if least is not None:
            left = left.where(F.col("bound") >= least)
        some = save(left.orderBy(F.desc("bound"), "person").limit(block))
        count = some.count()
        if not count:
            return best.orderBy(F.desc("centrality"), "person").limit(k)
        place = some.orderBy("bound", F.desc("person")).first()
        limit = sum_limit(F.col("r"), F.lit(n), F.lit(least).cast("double"))
        sums = bounded_sums(edges, some.select("person", "r", limit.alias("most")), n)
        found = sums.select("person", closeness(F.col("r"), F.col("s"), F.lit(n)).alias("centrality"))
        best = save(best.unionByName(found).orderBy(F.desc("centrality"), "person").limit(k))
        if best.count() == k:
            least = best.agg(F.min("centrality")).first()[0]
        if work is not None:
            work.rounds += 1
            work.searched += count
        block *= 2


def depth_bound(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """person, bound: a lower bound of the distance sum: levels up to `depth` exactly, the rest of the component one level further."""
    size = components(edges, nodes)
    held = size.groupBy("comp").agg(F.count("*").alias("r")).join(size, "comp").select(F.col("node").alias("person"), "r")
    near = sums_of(level_counts(edges, nodes, nodes, depth)).select("person", F.col("r").alias("seen"), "s")
    return near.join(held, "person").select("person", (F.col("s") + (F.col("r") - F.col("seen")) * (depth + 1)).cast("long").alias("bound"))


def distance_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """dist, pairs: ordered pairs of `nodes` at each distance, each with itself at 0."""
    return level_counts(edges, nodes, nodes).groupBy(F.col("level").alias("dist")).agg(F.sum("c").alias("pairs"))


def diameter(edges: DataFrame, nodes: DataFrame, block: int = 12, work: Work | None = None, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """One row, diameter: the longest distance between nodes that reach each other; null without nodes.

    A search from v gives its eccentricity e, and for each node w at distance d the bounds max(d, e - d) and e + d of its own. Rounds search from a few nodes, half of them with
    the highest upper bounds, half with the lowest (whose small eccentricities bound the others best), until no upper bound passes the longest distance found. Components of at
    most `task_edges` edges are searched so inside tasks, larger ones by joins, all in one loop.
    """
    edges, nodes = save(edges.select("src", "dst")), save(nodes.select("person").distinct())
    dealt = within.placed(edges, nodes, nodes, task_edges)
    inner = within.longest(dealt, block).agg(F.max("diameter"), F.sum("searched")).first()
    longest = (inner[0] or 0) if nodes.count() else None
    if work is not None:
        work.searched += inner[1] or 0
    if dealt.large:
        longest = _longest(*dealt.large, longest, block, work)
    return nodes.sparkSession.createDataFrame([(longest,)], "diameter int")


def _longest(edges: DataFrame, nodes: DataFrame, longest: int, block: int, work: Work | None) -> int:
    """The rounds of `diameter` by joins."""
    edges, nodes = save(edges), save(nodes)
    degree = edges.groupBy(F.col("src").alias("person")).agg(F.count("*").alias("degree"))
    size = save(components(edges, nodes))
    held = size.groupBy("comp").agg((F.count("*") - 1).alias("most")).join(size, "comp").select(F.col("node").alias("person"), "most")
    state = save(held.join(degree, "person", "left").select("person", F.lit(0).cast("long").alias("least"), "most", F.coalesce("degree", F.lit(0)).alias("degree")))
    while True:
        open_ = state.where(F.col("most") > longest)
        far = open_.orderBy(F.desc("most"), F.desc("degree"), "person").limit(block // 2)
        near = open_.orderBy("least", "most", F.desc("degree"), "person").limit(block - block // 2)
        sources = save(far.union(near).select("person").distinct())
        count = sources.count()
        if not count:
            return longest
        dist = save(reach(edges, sources))
        whole = dist.groupBy("source").agg(F.max("dist").cast("long").alias("e"))
        seen = dist.join(F.broadcast(whole), "source").groupBy(F.col("node").alias("person")).agg(F.max(F.greatest(F.col("dist"), F.col("e") - F.col("dist"))).alias("low"), F.min(F.col("e") + F.col("dist")).alias("high"))
        found = whole.select(F.col("source").alias("person"), "e")
        new = state.join(seen, "person", "left").join(F.broadcast(found), "person", "left")
        state = save(new.select("person", F.coalesce("e", F.greatest("least", "low")).alias("least"), F.coalesce("e", F.least("most", "high")).alias("most"), "degree"))
        longest = max(longest, state.agg(F.max("least")).first()[0])
        if work is not None:
            work.rounds += 1
            work.searched += count


def sampled_sums(edges: DataFrame, nodes: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """person, estimate: the distance sum, scaled up from the distances to a sample of the nodes; an estimate by design.

    Sampled nodes, and those of components without any, get their exact sums. The sample goes by arithmetic on the ids (fixed values).
    """
    edges, nodes = save(edges.select("src", "dst")), save(nodes.select("person").distinct())
    chosen = save(nodes.where(F.pmod(F.col("person") * 7919 + seed, F.lit(10_007)) < int(share * 10_007)))
    parts = save(components(edges, nodes))
    sizes = parts.groupBy("comp").agg(F.count("*").alias("r"))
    own, met = both_sums(edges, nodes, chosen)
    own, met = save(own), save(met)
    exact = own.select("person", F.col("s").cast("double").alias("estimate"))
    rest = met.join(exact, "person", "left_anti").join(parts, F.col("person") == F.col("node")).join(sizes, "comp")
    alone = save(nodes.join(met, "person", "left_anti"))
    inner = edges.join(alone.select(F.col("person").alias("src")), "src", "left_semi")
    apart = sums_of(level_counts(inner, alone, alone)).select("person", F.col("s").cast("double").alias("estimate"))
    return exact.union(rest.select("person", (F.col("s") / F.col("n") * F.col("r")).alias("estimate"))).union(apart)


def estimate_error(estimates: DataFrame, sums: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row: nodes with a distance sum above 0, mean relative error of their estimates (person, estimate) against `sums` (person, s), how many are off by more than `tolerance`."""
    off = F.abs(F.col("estimate") - F.col("s")) / F.col("s")
    both = estimates.join(sums.select("person", "s"), "person").where("s > 0").select(off.alias("off"))
    return both.agg(F.count("*").alias("nodes"), F.coalesce(F.avg("off"), F.lit(0.0)).alias("mean_error"), F.count_if(F.col("off") > tolerance).alias("beyond"))


def kth_largest(values: DataFrame, column: str, k: int) -> DataFrame:
    """One row, value: the k-th largest of a column, or the smallest if there are fewer rows; null without rows."""
    return values.select(F.col(column).alias("value")).orderBy(F.desc("value")).limit(k).agg(F.min("value").alias("value"))


def path_frequency(edges: DataFrame, sources: DataFrame, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """person, frequency: over all shortest paths from `sources` (person) to all other nodes, each pair's paths sharing a weight of 1, how much of it passes through each node that is neither end.

    Counts of paths go forward over the levels of a search from all sources, shares go backward over them: inside tasks for components of at most `task_edges` edges, else by
    joins, one a level each. Nodes on no such path are left out.
    """
    sources = save(sources.select("person").distinct())
    dealt = within.placed(edges, sources, sources, task_edges)
    out = within.frequencies(dealt)
    if dealt.large:
        out = out.unionByName(_frequency(*dealt.large))
    return out.groupBy("person").agg(F.sum("frequency").alias("frequency"))


def _frequency(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """`path_frequency` by joins."""
    edges = save(edges.select("src", "dst"))
    front = save(sources.select(F.col("person").alias("source"), F.col("person").alias("node"), F.lit(1.0).alias("paths")).distinct())
    levels, last = [front], front
    while True:
        near = levels[-1].join(edges, levels[-1].node == edges.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = save(near.join(levels[-1], ["source", "node"], "left_anti").join(last, ["source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        last = levels[-1]
        levels.append(fresh)
    out, share = None, None
    for level in range(len(levels) - 1, 0, -1):
        held = levels[level] if share is None else levels[level].join(share, ["source", "node"], "left")
        through = F.lit(0.0) if share is None else F.coalesce("through", F.lit(0.0))
        held = save(held.select("source", "node", "paths", through.alias("through")))
        part = held.groupBy("node").agg(F.sum("through").alias("f"))
        out = part if out is None else out.unionByName(part)
        # what ends in or passes through a node is dealt to its predecessors by their paths
        up = held.select("source", F.col("node").alias("dst"), ((1 + F.col("through")) / F.col("paths")).alias("each")).join(edges, "dst")
        share = up.join(levels[level - 1], (up.src == levels[level - 1].node) & (up.source == levels[level - 1].source))
        share = save(share.select(up.source, "node", (F.col("paths") * F.col("each")).alias("through")).groupBy("source", "node").agg(F.sum("through").alias("through")))
    if out is None:
        return sources.where("false").select("person", F.lit(0.0).alias("frequency"))
    return out.groupBy(F.col("node").alias("person")).agg(F.sum("f").alias("frequency")).where("frequency > 0")
