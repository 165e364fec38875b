"""The four queries as plans: (network, parameters) to a DataFrame, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import centrality, graph, overlap, search, within
from ..sources.network import Network


#: From so many targets on, a source's queries share one search that starts at the source alone.
MANY_TARGETS = 16


def shortest_paths(net: Network, asked: DataFrame) -> DataFrame:
    """query_no, distance (-1: unreachable) of each row (query_no, p1, p2, x) of `asked`.

    Single pairs are searched from both ends, all in one loop; the pairs of a source with many targets by a search from the source, one loop for each x.
    """
    asked = graph.save(asked.select("query_no", "p1", "p2", "x"))
    ranges = asked.agg(F.max("x")).first()[0]
    if ranges is None:
        return asked.select("query_no", F.lit(-1).alias("distance"))
    edges = weighted(net, ranges)
    targets = asked.groupBy("p1", "x").agg(F.count("*").alias("targets"))
    split = graph.save(asked.join(targets, ["p1", "x"]))
    parts = [search.meet(edges, split.where(F.col("targets") < MANY_TARGETS).withColumn("h", F.lit(None).cast("int")))]
    broad = split.where(F.col("targets") >= MANY_TARGETS).drop("targets")
    for (x,) in sorted(broad.select(F.greatest("x", F.lit(-1))).distinct().collect()):
        mine = broad.where(F.greatest("x", F.lit(-1)) == x)
        kept = edges if x < 0 else edges.where(F.col("reply_min") > x)
        wanted = mine.select(F.col("p1").alias("source"), F.col("p2").alias("node"))
        dist = graph.reach(kept.select("src", "dst"), mine.select(F.col("p1").alias("person")), wanted=wanted)
        found = dist.select(F.col("source").alias("p1"), F.col("node").alias("p2"), "dist")
        parts.append(mine.join(found, ["p1", "p2"], "left").select("query_no", F.coalesce("dist", F.lit(-1)).cast("int").alias("distance")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def weighted(net: Network, largest_x: int = 0) -> DataFrame:
    """src, dst, reply_min of the friendships; the replies are not read where no query asks for them (largest_x < 0)."""
    if largest_x < 0:
        return net.knows.select("src", "dst", F.lit(0).cast("long").alias("reply_min"))
    return graph.save(graph.reply_weights(net.knows, net.replies))


def path_nodes(net: Network, asked: DataFrame) -> DataFrame:
    """query_no, step, person along a shortest path of each row (query_no, p1, p2) of `asked`, over all friendships."""
    return search.path_nodes(net.knows, asked)


def shortest_path(net: Network, p1: int, p2: int, x: int) -> DataFrame:
    asked = net.spark.createDataFrame([(0, p1, p2, x)], "query_no long, p1 long, p2 long, x int")
    return shortest_paths(net, asked).select("distance")


def interest_ranges(net: Network, asked: DataFrame) -> DataFrame:
    """query_no, tag, size: for each (query_no, since) of `asked`, the largest group of a tag's followers born on `since` or later who are connected through such followers.

    All queries and tags share one loop.
    """
    fans = young_followers(net, asked)
    fans = graph.save(fans.select("query_no", "tag", "person"))
    once = net.knows.where("src < dst")
    edges = once.join(fans.withColumnRenamed("person", "src"), "src").join(fans.withColumnRenamed("person", "dst"), ["dst", "query_no", "tag"]).select("query_no", "tag", "src", "dst")
    comps = graph.components(edges, fans, ("query_no", "tag"))
    return comps.groupBy("query_no", "tag", "comp").agg(F.count("*").alias("size")).groupBy("query_no", "tag").agg(F.max("size").alias("size"))


def interest_ranges_by_forest(net: Network, asked: DataFrame, task_edges: int = within.TASK_EDGES) -> DataFrame:
    """As `interest_ranges`, for many dates: each tag's friendships are joined once, by the date up to which both friends count.

    A tag of at most `task_edges` friendships is read in one task, from the last date down; those of a larger one are thinned to spanning forests, which the dates read.
    """
    since = graph.save(asked.select("query_no", F.col("since").cast("date").alias("since")))
    weights = [row.day for row in since.select(F.unix_date("since").alias("day")).distinct().collect() if row.day is not None]
    born = net.person.select(F.col("id").alias("person"), "birthday").where(F.unix_date("birthday") >= F.lit(min(weights, default=None)))
    fans = graph.save(net.interest.distinct().join(born, "person"))
    lists = fans.groupBy("person", "birthday").agg(F.collect_list("tag").alias("tags"))
    ends = [lists.select(F.col("person").alias(name), F.col("birthday").alias(f"{name}_born"), F.col("tags").alias(f"{name}_tags")) for name in ("src", "dst")]
    both = net.knows.where("src < dst").join(ends[0], "src").join(ends[1], "dst")
    edges = graph.save(both.select(F.explode(F.array_intersect("src_tags", "dst_tags")).alias("tag"), "src", "dst", F.least("src_born", "dst_born").alias("weight")))
    wide = edges.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select("tag")
    best = within.largest_groups(edges.join(wide, "tag", "left_anti").withColumn("weight", F.unix_date("weight")), weights)
    found = since.join(best, F.unix_date("since") == F.col("weight")).select("query_no", "tag", "size")
    if not wide.isEmpty():
        found = found.unionByName(_ranges_by_forest(edges.join(wide, "tag", "left_semi"), fans.join(wide, "tag", "left_semi"), F.broadcast(since)))
    followed = fans.groupBy("tag").agg(F.max("birthday").alias("youngest")).join(F.broadcast(since), F.col("youngest") >= F.col("since")).select("query_no", "tag")
    return followed.join(found, ["query_no", "tag"], "left").select("query_no", "tag", F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def _ranges_by_forest(edges: DataFrame, fans: DataFrame, since: DataFrame) -> DataFrame:
    """The ranges of tags with very many friendships."""
    forest = graph.save(graph.thinned(edges, ("tag",)))
    alive = forest.join(since, F.col("weight") >= F.col("since")).select("query_no", "tag", "src", "dst")
    young = fans.join(since, F.col("birthday") >= F.col("since")).select("query_no", "tag", "person")
    comps = graph.components(alive, young, ("query_no", "tag"))
    return comps.groupBy("query_no", "tag", "comp").agg(F.count("*").alias("size")).groupBy("query_no", "tag").agg(F.max("size").alias("size"))


def young_followers(net: Network, asked: DataFrame) -> DataFrame:
    """query_no, tag, person. `asked` is a set of queries, not a table of the data."""
    born = net.interest.join(net.person.select(F.col("id").alias("person"), "birthday"), "person")
    since = asked.select("query_no", F.col("since").cast("date").alias("since"))
    return born.join(F.broadcast(since), F.col("birthday") >= F.col("since")).select("query_no", "tag", "person").distinct()


def top_interests_of(net: Network, asked: DataFrame) -> DataFrame:
    """query_no, name, size: for each (query_no, k, since), the k tags with the largest ranges, by size, then name."""
    asked = graph.save(asked)
    ranges = interest_ranges if asked.count() == 1 else interest_ranges_by_forest
    known = graph.save(ranges(net, asked))
    named = known.join(net.tag.select(F.col("id").alias("tag"), "name"), "tag").join(asked.select("query_no", "k"), "query_no")
    best = Window.partitionBy("query_no").orderBy(F.desc("size"), "name")
    return named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.col("k")).select("query_no", "name", "size")


def _one(net: Network, k: int, since: str) -> DataFrame:
    return net.spark.createDataFrame([(0, k, since)], "query_no long, k int, since string")


def top_interests(net: Network, k: int, since: str, include_empty: bool = False) -> DataFrame:
    """name, size of the k tags with the largest ranges, by size, then name. `include_empty`: tags without followers count as ranges of 0."""
    if not include_empty:
        return top_interests_of(net, _one(net, k, since)).select("name", "size").orderBy(F.desc("size"), "name").limit(k)
    ranked = net.tag.join(interest_ranges(net, _one(net, k, since)), net.tag.id == F.col("tag"), "left")
    return ranked.select("name", F.coalesce("size", F.lit(0)).alias("size")).orderBy(F.desc("size"), "name").limit(k)


def persons_in_place(net: Network, name: str) -> DataFrame:
    """person: tied (home, study, work) to a place of this name or one inside it."""
    inside = graph.place_closure(net.place, net.part_of).join(net.place.where(F.col("name") == name), F.col("ancestor") == F.col("id"), "left_semi").select(F.col("descendant").alias("place"))
    return net.located.join(inside.distinct(), "place", "left_semi").select("person").distinct()


def near_pairs(net: Network, members: DataFrame, hops: int) -> DataFrame:
    """a < b: members within `hops` of each other, through anyone."""
    members = graph.save(members)
    dist = graph.reach(net.knows, members, hops).where("source < node")
    return dist.join(members.select(F.col("person").alias("node")), "node", "left_semi").select(F.col("source").alias("a"), F.col("node").alias("b"))


#: Rows that a search from all members makes in about the time that the rounds of the other plan take to start and end.
ROUNDS_IN_ROWS = 20_000_000


def similar_pairs(net: Network, k: int, hops: int, place: str, plan: str | None = None) -> DataFrame:
    """a, b, common: the k pairs tied to `place`, at most `hops` apart, with most interests in common; by common, a, b.

    Plan "reach" searches from all members and counts what the pairs within `hops` share; "overlap" takes pairs by what they share and measures how far apart they are.
    Without a name, the one with fewer rows by `overlap.costs` is taken.
    """
    members = graph.save(persons_in_place(net, place))
    if plan is None:
        far, shared = overlap.costs(net.knows, net.interest, members, hops)
        plan = "reach" if far <= shared + ROUNDS_IN_ROWS else "overlap"
    if plan == "overlap":
        return overlap.overlap_first(net.knows, net.interest, members, k, hops)
    return graph.common_interests(near_pairs(net, members, hops), net.interest).orderBy(F.desc("common"), "a", "b").limit(k)


def pairs_within(net: Network, pairs: DataFrame) -> DataFrame:
    """The rows of `pairs` (query_no, p1, p2, h) that are at most h friendships apart, with their distance."""
    edges = weighted(net, -1)
    distance = search.meet(edges, pairs.select("query_no", "p1", "p2", F.lit(-1).alias("x"), "h")).where("distance >= 0")
    return pairs.join(distance, "query_no").select("query_no", "p1", "p2", "h", "distance")


def topic_members(net: Network, name: str) -> DataFrame:
    """person: members of forums that carry a tag of this name."""
    tags = net.tag.where(F.col("name") == name).select(F.col("id").alias("tag"))
    forums = net.forum_tag.join(tags, "tag", "left_semi").select("forum").distinct()
    return net.forum_member.join(forums, "forum", "left_semi").select("person").distinct()


def centralities(net: Network, name: str, drop_isolated: bool = False) -> DataFrame:
    """person, r, s, n, centrality within the graph of the topic's members."""
    members = graph.save(topic_members(net, name))
    edges = graph.save(graph.induced(net.knows, members))
    if drop_isolated:
        members = graph.save(members.join(edges.select(F.col("src").alias("person")), "person", "left_semi"))
    n = members.count()
    sums = centrality.distance_sums(edges, members).withColumn("n", F.lit(n))
    return sums.withColumn("centrality", centrality.closeness(F.col("r"), F.col("s"), F.col("n")))


def top_central(net: Network, k: int, name: str, drop_isolated: bool = False) -> DataFrame:
    """person, centrality of the k most central members, by centrality, then id."""
    return centralities(net, name, drop_isolated).select("person", "centrality").orderBy(F.desc("centrality"), "person").limit(k)



def top_central_bounded(net: Network, k: int, name: str, work: search.Work | None = None) -> DataFrame:
    """As `top_central`, searching only from members whose bounds may reach the k-th place."""
    members = graph.save(topic_members(net, name))
    return centrality.most_central(graph.save(graph.induced(net.knows, members)), members, k, work=work)
