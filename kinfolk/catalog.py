"""The registered queries of the graph engine over the supplied tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import centrality, graph, search
from .plans import social
from .sources.network import Network, broken_lines, read_folder, read_star_schema, symmetric, write_folder

SINCE = "1995-06-01"
FLAGSHIP = "q4_topk"
#: Queries (number, k, date) that are answered together.
BATCH = [(1, 5, "1994-06-01"), (2, 10, "1995-06-01"), (3, 40, "1996-01-01"), (4, 3, "2030-01-01")]

#: A date of each year of the tables.
DATES = [(year, 1, f"{year}-03-01") for year in range(1992, 1999)]


def first_topic(net: Network) -> str:
    return net.tag.agg(F.min("name")).first()[0]


def event_network(net: Network) -> Network:
    """The graph of users who reply to each other: all who ever do are friends."""
    net.knows = graph.save(symmetric(net.replies))
    return net


def _asked(net: Network, x: int) -> DataFrame:
    """From the smallest node to every one."""
    node = net.knows.select(F.col("src").alias("p2")).distinct()
    start = net.knows.agg(F.min("src").alias("p1"))
    return node.join(F.broadcast(start)).select(F.col("p2").alias("query_no"), "p1", "p2", F.lit(x).alias("x"))


def _batch(net: Network, x: int) -> DataFrame:
    return social.shortest_paths(net, _asked(net, x)).select(F.col("query_no").alias("p2"), "distance")


def _dates(net: Network, asked: list[tuple[int, int, str]]) -> DataFrame:
    return net.spark.createDataFrame(asked, "query_no long, k int, since string")


def _named(net: Network, rows: DataFrame) -> DataFrame:
    """`tag` ids as names."""
    return rows.join(net.tag.select(F.col("id").alias("tag"), "name"), "tag").drop("tag")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("person", F.round("centrality", 9).alias("centrality"))


def _members(net: Network) -> DataFrame:
    return graph.save(social.topic_members(net, first_topic(net)))


def _pairs(net: Network) -> DataFrame:
    """query_no, p1, p2, x, h: from every 20th person to one that its id picks, with x from -1 to 4 and h from 1 to 7."""
    ids = net.knows.select(F.col("src").alias("p1")).distinct()
    far = net.knows.agg(F.max("src").alias("top"))
    asked = ids.where("p1 % 20 = 0").join(F.broadcast(far)).select("p1", F.expr("(p1 * 7919 + 13) % (top + 1)").alias("p2"))
    return asked.select(F.col("p1").alias("query_no"), "p1", "p2", F.expr("CAST(p1 div 20 % 6 - 1 AS INT)").alias("x"), F.expr("CAST(1 + p1 div 20 % 7 AS INT)").alias("h"))


def _inner(net: Network, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """`apply` to the members of the first topic and the friendships among them."""
    members = _members(net)
    return apply(graph.save(graph.induced(net.knows, members)), members)


def _files(net: Network) -> str:
    return write_folder(net, f"{graph.scratch_dir(net.spark)}/kinfolk-files-{uuid.uuid4().hex}")


def _by_files(net: Network) -> Network:
    """The network written as a folder of delimited files and read back."""
    return read_folder(net.spark, _files(net))


def _query_lines(net: Network) -> DataFrame:
    """query_no, value: a line of a query file for each asked pair, birthday, place and tag."""
    paths = _pairs(net).select(F.format_string("query1(%d, %d, %d)", "p1", "p2", "x").alias("value"))
    dates = net.person.where("birthday IS NOT NULL").select(F.format_string("  query2(%d, %s)", F.col("id") % 8 + 1, F.date_format("birthday", "yyyy-MM-dd")).alias("value"))
    places = net.place.select(F.format_string("query3(%d,%d,%s)", F.col("id") % 8 + 1, F.col("id") % 7 + 1, "name").alias("value"))
    tags = net.tag.select(F.format_string("query4(3, %s) ", "name").alias("value"))
    other = net.spark.createDataFrame([("",), ("query5(1, 2)",), ("no query",)], "value string")
    return paths.unionByName(dates).unionByName(places).unionByName(tags).unionByName(other).withColumn("query_no", F.monotonically_increasing_id())


PLANS: dict[str, Callable[[Network], DataFrame]] = {
    "knows_edges": lambda net: net.knows,
    "degree": lambda net: net.knows.groupBy(F.col("src").alias("person")).agg(F.count("*").alias("degree")),
    "sorted_adjacency": lambda net: net.knows.groupBy(F.col("src").alias("person")).agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("friends")),
    "reply_counts": lambda net: graph.reply_counts(net.replies),
    "friend_reply_semi": lambda net: net.replies.join(net.knows, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n")),
    "reply_min": lambda net: (lambda n: graph.reply_weights(n.knows, n.replies))(event_network(net)),
    "replies_of_pairs": lambda net: (lambda n: graph.replies_between(n.replies, n.knows.where("src < dst AND (src + dst) % 3 = 0").select((F.col("src") * 1_000_000 + F.col("dst")).alias("query_no"), F.col("src").alias("p1"), F.col("dst").alias("p2"))))(event_network(net)),
    "interest_stats": lambda net: _named(net, net.interest.join(net.person, F.col("person") == F.col("id")).groupBy("tag").agg(F.count("*").alias("persons"), F.max("birthday").cast("string").alias("youngest"))),
    "tag_lookup": lambda net: net.forum_tag.join(net.tag.where(F.col("name") == first_topic(net)), F.col("tag") == F.col("id"), "left_semi").select("forum"),
    "place_closure": lambda net: graph.place_closure(net.place, net.part_of),
    "persons_in_place": lambda net: social.persons_in_place(net, "ASIA"),
    "forum_members_of_tag": lambda net: _members(net),
    "induced_subgraph": lambda net: graph.induced(net.knows, _members(net)),
    "components": lambda net: (lambda m: graph.components(graph.induced(net.knows, m), m))(_members(net)),
    "largest_component_per_tag": lambda net: _named(net, social.interest_ranges(net, _dates(net, [(0, 1, SINCE)])).drop("query_no")),
    "bfs_levels": lambda net: graph.reach(net.knows, net.knows.agg(F.min("src").alias("person"))).select("node", "dist"),
    "reach_within_h": lambda net: graph.reach(net.knows, social.persons_in_place(net, "NATION_3"), 2),
    "common_interest_count": lambda net: graph.common_interests(net.knows.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), net.interest),
    "distance_sum": lambda net: (lambda m: centrality.distance_sums(graph.induced(net.knows, m), m))(_members(net)),
    "closeness": lambda net: _rounded(social.centralities(net, first_topic(net))),
    "two_hop_neighbours": lambda net: graph.two_hop_neighbours(graph.induced(net.knows, _members(net))),
    "depth_limited_bound": lambda net: (lambda m: centrality.depth_bound(graph.induced(net.knows, m), m, 2))(_members(net)),
    "sampled_distance_sum": lambda net: (lambda m: centrality.sampled_sums(graph.induced(net.knows, m), m, 0.1))(_members(net)).select("person", F.round("estimate", 6).alias("estimate")),
    "masked_distance_sum": lambda net: (lambda m: centrality.masked_sums(graph.induced(net.knows, m), m, pass_rows=1 << 20))(_members(net)),
    "estimate_error": lambda net: _inner(net, lambda e, m: centrality.estimate_error(centrality.sampled_sums(e, m, 0.1), centrality.masked_sums(e, m))).select("nodes", F.round("mean_error", 9).alias("mean_error"), "beyond"),
    "kth_of_sample": lambda net: centrality.kth_largest(_rounded(social.centralities(net, first_topic(net))).where("person % 3 = 0"), "centrality", 5),
    "distance_histogram": lambda net: (lambda m: centrality.distance_histogram(graph.induced(net.knows, m), m))(_members(net)),
    "diameter": lambda net: (lambda m: centrality.diameter(graph.induced(net.knows, m), m))(_members(net)),
    "hop3_counts": lambda net: _inner(net, lambda e, m: search.hop_counts(e, m, 3)),
    "neighbourhood_sizes": lambda net: _inner(net, lambda e, m: search.walk_counts(e, m, 4)).select("person", *(F.get("walks", F.lit(i)).alias(f"w{i + 1}") for i in range(4))),
    "path_node_frequency": lambda net: _inner(net, lambda e, m: centrality.path_frequency(e, m.where("person % 10 = 0"))).select("person", F.round("frequency", 6).alias("frequency")),
    "q2_batch": lambda net: social.top_interests_of(net, _dates(net, BATCH)),
    "q2_all_dates": lambda net: _named(net, social.interest_ranges_by_forest(net, _dates(net, DATES))),
    "q1_path_nofilter": lambda net: _batch(net, -1),
    "q1_path_x0": lambda net: _batch(event_network(net), 0),
    "q1_path_x1": lambda net: _batch(event_network(net), 1),
    "q1_path_pairs": lambda net: (lambda n: social.shortest_paths(n, _pairs(n)))(event_network(net)),
    "q1_path_nodes": lambda net: social.path_nodes(net, _pairs(net)),
    "pairs_within_h": lambda net: social.pairs_within(net, _pairs(net)).drop("query_no"),
    "q2_topk": lambda net: social.top_interests(net, 8, SINCE),
    "q2_topk_pad": lambda net: social.top_interests(net, 200, "1998-01-01", include_empty=True),
    "q2_answer": lambda net: text.joined(social.top_interests(net, 5, SINCE), F.col("name"), -F.col("size"), F.col("name")),
    "q3_nation_h1": lambda net: social.similar_pairs(net, 20, 1, "NATION_3"),
    "q3_nation_h2": lambda net: social.similar_pairs(net, 20, 2, "NATION_7"),
    "q3_region_h1": lambda net: social.similar_pairs(net, 20, 1, "EUROPE"),
    "q3_unknown_place": lambda net: social.similar_pairs(net, 5, 2, "Nowhere"),
    "q3_overlap_first": lambda net: social.similar_pairs(net, 20, 2, "NATION_7", plan="overlap"),
    "q3_overlap_h3": lambda net: social.similar_pairs(net, 50, 3, "NATION_5", plan="overlap"),
    "q3_chosen_plan": lambda net: social.similar_pairs(net, 30, 3, "NATION_9"),
    "q3_answer": lambda net: text.joined(social.similar_pairs(net, 5, 1, "NATION_3"), F.concat_ws("|", "a", "b"), -F.col("common"), F.col("a"), F.col("b")),
    "q4_topk": lambda net: _rounded(social.top_central(net, 10, first_topic(net))),
    "q4_topk_bounded": lambda net: _rounded(social.top_central_bounded(net, 10, first_topic(net))),
    "q4_answer": lambda net: text.joined(social.top_central(net, 7, first_topic(net)), F.col("person").cast("string"), -F.col("centrality"), F.col("person")),
    "q4_drop_isolated": lambda net: _rounded(social.top_central(net, 10, first_topic(net), drop_isolated=True)),
    "graph_dump": lambda net: text.dumped(net.knows),
    "files_lines": lambda net: broken_lines(net.spark, _files(net)),
    "files_reply_counts": lambda net: graph.reply_counts(_by_files(net).replies),
    "files_located": lambda net: _by_files(net).located,
    "files_interest_stats": lambda net: (lambda n: _named(n, n.interest.join(n.person, F.col("person") == F.col("id")).groupBy("tag").agg(F.count("*").alias("persons"), F.max("birthday").cast("string").alias("youngest"))))(_by_files(net)),
    "files_q1_pairs": lambda net: (lambda n: social.shortest_paths(n, _pairs(n)))(_by_files(event_network(net))),
    "files_q2_topk": lambda net: social.top_interests(_by_files(net), 8, SINCE),
    "files_q3_nation_h1": lambda net: social.similar_pairs(_by_files(net), 20, 1, "NATION_3"),
    "files_q4_topk": lambda net: (lambda n: _rounded(social.top_central(n, 10, first_topic(n))))(_by_files(net)),
    "query_text_kinds": lambda net: text.parsed(_query_lines(net)).select("kind", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("p1", "p2", "x", "k", "d", "h", "name"))).alias("parts")),
    "query_text_parse": lambda net: text.parsed(net.tag.select(F.lit(0).cast("long").alias("query_no"), F.concat(F.lit("query4(3, "), "name", F.lit(")")).alias("value"))).select("kind", "k", "name"),
    "answer_parse": lambda net: net.tag.select(text.answer_of(F.concat("name", F.lit(" % a comment"))).alias("answer")),
}

_BASE = f"""
parts AS (SELECT p_partkey, p_brand || '/' || p_type AS topic FROM part),
pairs AS (SELECT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
knows AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
replies AS (SELECT CAST(a.user_id AS BIGINT) AS src, CAST(b.user_id AS BIGINT) AS dst FROM events a JOIN events b ON a.event_id = b.event_id + 1),
counts AS (SELECT src, dst, count(*) AS n FROM replies WHERE src <> dst GROUP BY 1, 2),
talk AS (SELECT src, dst FROM counts UNION SELECT dst, src FROM counts),
weights AS (SELECT t.src, t.dst, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS reply_min FROM talk t
  LEFT JOIN counts a ON a.src = t.src AND a.dst = t.dst LEFT JOIN counts b ON b.src = t.dst AND b.dst = t.src),
bought AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
interest AS (SELECT DISTINCT o_custkey AS person, topic FROM bought JOIN parts ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
person AS (SELECT c_custkey AS id, min(CAST(o_orderdate AS DATE)) AS birthday FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
place AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), r_name FROM region),
part_of AS (SELECT CAST(n_nationkey AS BIGINT) AS child, CAST(1000 + n_regionkey AS BIGINT) AS parent FROM nation),
closure AS (SELECT id AS ancestor, id AS descendant FROM place UNION SELECT parent, child FROM part_of),
located AS (SELECT c_custkey AS person, CAST(c_nationkey AS BIGINT) AS place FROM customer UNION SELECT o_custkey, CAST(s_nationkey AS BIGINT) FROM bought JOIN supplier ON l_suppkey = s_suppkey
  WHERE (l_linenumber = 1 AND l_discount < 0.005) OR (l_linenumber = 2 AND l_discount > 0.095)),
members AS (SELECT DISTINCT o_custkey AS person FROM bought JOIN parts ON l_partkey = p_partkey WHERE topic = (SELECT min(topic) FROM parts)),
inner_edges AS (SELECT src, dst FROM knows WHERE src IN (SELECT person FROM members) AND dst IN (SELECT person FROM members)),
fans AS (SELECT topic, person FROM interest JOIN person ON id = person WHERE birthday >= DATE '{SINCE}'),
fan_edges AS (SELECT a.topic, src, dst FROM knows JOIN fans a ON a.person = src JOIN fans b ON b.person = dst AND a.topic = b.topic)"""
#: A walk gets a level limit where UNION alone would not end it.
_WALK = "walk(source, node, dist) AS (SELECT person, person, 0 FROM {start} UNION SELECT source, dst, dist + 1 FROM walk JOIN {edges} e ON e.src = walk.node WHERE dist < {depth})"
_DIST = "dist AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"
_INNER = _WALK.format(start="members", edges="inner_edges", depth=9) + ",\n" + _DIST
_FANS = "spread(topic, person, other) AS (SELECT topic, person, person FROM fans UNION SELECT s.topic, s.person, e.dst FROM spread s JOIN fan_edges e ON e.topic = s.topic AND e.src = s.other),\nsizes AS (SELECT topic, max(n) AS size FROM (SELECT topic, person, count(*) AS n FROM spread GROUP BY 1, 2) GROUP BY 1)"


def _sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_BASE.strip(), *ctes]) + "\n" + body


def _paths(edges: str, filtered: str) -> str:
    return _sql(
        f"SELECT p2, coalesce(dist, -1) AS distance FROM (SELECT DISTINCT src AS p2 FROM {edges}) LEFT JOIN dist ON node = p2",
        f"start AS (SELECT min(src) AS person FROM {edges})", f"kept AS ({filtered})", _WALK.format(start="start", edges="kept", depth=14), _DIST,
    )


def _similar(k: int, hops: int, place: str, answer: bool = False) -> str:
    body = """SELECT a, b, CAST((SELECT count(*) FROM interest x JOIN interest y ON x.topic = y.topic WHERE x.person = a AND y.person = b) AS BIGINT) AS common
FROM (SELECT source AS a, node AS b FROM dist WHERE source < node AND node IN (SELECT person FROM tied))"""
    top = f"SELECT * FROM ({body}) ORDER BY common DESC, a, b LIMIT {k}"
    return _sql(f"SELECT coalesce(string_agg(a || '|' || b, ' ' ORDER BY common DESC, a, b), '') AS answer FROM ({top})" if answer else top,
        f"tied AS (SELECT DISTINCT person FROM located WHERE place IN (SELECT descendant FROM closure JOIN place ON id = ancestor WHERE name = '{place}'))", _WALK.format(start="tied", edges="knows", depth=hops), _DIST)


_ASKED = "asked AS (SELECT p1, (p1 * 7919 + 13) % (top + 1) AS p2, p1 // 20 % 6 - 1 AS x, CAST(1 + p1 // 20 % 7 AS INT) AS h, p1 AS query_no FROM (SELECT DISTINCT src AS p1 FROM {edges}), (SELECT max(src) AS top FROM {edges}) WHERE p1 % 20 = 0)"
_SUMS = "sums AS (SELECT source AS person, count(*) AS r, CAST(sum(dist) AS BIGINT) AS s FROM dist GROUP BY 1)"
_CLOSE = "CASE WHEN s > 0 THEN round(CAST((r - 1) * (r - 1) AS DOUBLE) / (CAST(n - 1 AS DOUBLE) * s), 9) ELSE 0 END AS centrality"
_ALL = f"close_ AS (SELECT person, {_CLOSE} FROM sums, (SELECT count(*) AS n FROM members))"
_SOCIAL = f"close_ AS (SELECT person, {_CLOSE} FROM sums, (SELECT count(DISTINCT src) AS n FROM inner_edges) WHERE r > 1)"



def _young(asked: list[tuple[int, int, str]]) -> list[str]:
    """The followers for each asked date, who reaches whom among them, and the largest range of each tag."""
    return [
        "asked(query_no, k, since) AS (VALUES " + ", ".join(f"(CAST({n} AS BIGINT), {k}, DATE '{d}')" for n, k, d in asked) + ")",
        "young AS (SELECT query_no, topic, person FROM interest JOIN person ON id = person JOIN asked ON birthday >= since)",
        "young_edges AS (SELECT a.query_no, a.topic, src, dst FROM knows JOIN young a ON a.person = src JOIN young b ON b.person = dst AND a.topic = b.topic AND a.query_no = b.query_no)",
        "spread(query_no, topic, person, other) AS (SELECT query_no, topic, person, person FROM young UNION SELECT s.query_no, s.topic, s.person, e.dst FROM spread s JOIN young_edges e ON e.query_no = s.query_no AND e.topic = s.topic AND e.src = s.other)",
        "sizes AS (SELECT query_no, topic, max(n) AS size FROM (SELECT query_no, topic, person, count(*) AS n FROM spread GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    ]


ORACLE_SQL: dict[str, str] = {
    "knows_edges": _sql("SELECT src, dst FROM knows"),
    "degree": _sql("SELECT src AS person, count(*) AS degree FROM knows GROUP BY 1"),
    "sorted_adjacency": _sql("SELECT src AS person, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS friends FROM knows GROUP BY 1"),
    "reply_counts": _sql("SELECT src, dst, n FROM counts"),
    "friend_reply_semi": _sql("SELECT src, dst, count(*) AS n FROM replies SEMI JOIN knows USING (src, dst) GROUP BY 1, 2"),
    "reply_min": _sql("SELECT src, dst, reply_min FROM weights"),
    "replies_of_pairs": _sql("SELECT t.src * 1000000 + t.dst AS query_no, coalesce(a.n, 0) AS forth, coalesce(b.n, 0) AS back FROM talk t LEFT JOIN counts a ON a.src = t.src AND a.dst = t.dst LEFT JOIN counts b ON b.src = t.dst AND b.dst = t.src WHERE t.src < t.dst AND (t.src + t.dst) % 3 = 0"),
    "interest_stats": _sql("SELECT topic AS name, count(*) AS persons, CAST(max(birthday) AS VARCHAR) AS youngest FROM interest JOIN person ON id = person GROUP BY 1"),
    "tag_lookup": _sql("SELECT p_partkey AS forum FROM parts WHERE topic = (SELECT min(topic) FROM parts)"),
    "place_closure": _sql("SELECT ancestor, descendant FROM closure"),
    "persons_in_place": _sql("SELECT DISTINCT person FROM located WHERE place IN (SELECT descendant FROM closure JOIN place ON id = ancestor WHERE name = 'ASIA')"),
    "forum_members_of_tag": _sql("SELECT person FROM members"),
    "induced_subgraph": _sql("SELECT src, dst FROM inner_edges"),
    "components": _sql("SELECT source AS node, min(node) AS comp FROM dist GROUP BY 1", _INNER),
    "largest_component_per_tag": _sql("SELECT topic AS name, size FROM sizes", _FANS),
    "bfs_levels": _sql("SELECT node, dist FROM dist", "start AS (SELECT min(src) AS person FROM knows)", _WALK.format(start="start", edges="knows", depth=9), _DIST),
    "reach_within_h": _sql("SELECT source, node, dist FROM dist", "tied AS (SELECT DISTINCT person FROM located WHERE place IN (SELECT id FROM place WHERE name = 'NATION_3'))", _WALK.format(start="tied", edges="knows", depth=2), _DIST),
    "common_interest_count": _sql("SELECT src AS a, dst AS b, count(y.topic) AS common FROM knows LEFT JOIN interest x ON x.person = src LEFT JOIN interest y ON y.person = dst AND y.topic = x.topic WHERE src < dst GROUP BY 1, 2"),
    "distance_sum": _sql("SELECT person, r, s FROM sums", _INNER, _SUMS),
    "closeness": _sql("SELECT person, centrality FROM close_", _INNER, _SUMS, _ALL),
    "two_hop_neighbours": _sql("SELECT DISTINCT a.src AS person, b.dst AS other FROM inner_edges a JOIN inner_edges b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM inner_edges e WHERE e.src = a.src AND e.dst = b.dst)"),
    "depth_limited_bound": _sql("SELECT source AS person, CAST(sum(least(dist, 3)) AS BIGINT) AS bound FROM dist GROUP BY 1", _INNER),
    "sampled_distance_sum": _sql("""SELECT person, round(CASE WHEN (person * 7919 + 1) % 10007 < 1000 OR mean IS NULL THEN CAST(s AS DOUBLE) ELSE mean * r END, 6) AS estimate FROM sums LEFT JOIN means ON node = person""",
        _INNER, _SUMS, "means AS (SELECT node, avg(dist) AS mean FROM dist WHERE (source * 7919 + 1) % 10007 < 1000 GROUP BY 1)"),
    "masked_distance_sum": _sql("SELECT person, CAST(r AS BIGINT) AS r, s FROM sums", _INNER, _SUMS),
    "estimate_error": _sql("SELECT count(*) AS nodes, round(coalesce(avg(off), 0), 9) AS mean_error, count(*) FILTER (off > 0.05) AS beyond FROM (SELECT abs(CASE WHEN (person * 7919 + 1) % 10007 < 1000 OR mean IS NULL THEN CAST(s AS DOUBLE) ELSE mean * r END - s) / s AS off FROM sums LEFT JOIN means ON node = person WHERE s > 0)",
        _INNER, _SUMS, "means AS (SELECT node, avg(dist) AS mean FROM dist WHERE (source * 7919 + 1) % 10007 < 1000 GROUP BY 1)"),
    "kth_of_sample": _sql("SELECT min(centrality) AS value FROM (SELECT centrality FROM close_ WHERE person % 3 = 0 ORDER BY centrality DESC LIMIT 5)", _INNER, _SUMS, _ALL),
    "distance_histogram": _sql("SELECT dist, count(*) AS pairs FROM dist GROUP BY 1", _INNER),
    "diameter": _sql("SELECT max(dist) AS diameter FROM dist", _INNER),
    "hop3_counts": _sql("SELECT source AS person, count(*) FILTER (dist <= 1) - 1 AS h1, count(*) FILTER (dist <= 2) - 1 AS h2, count(*) FILTER (dist <= 3) - 1 AS h3 FROM dist GROUP BY 1", _INNER),
    # walks that do not turn back, each from the walks one and two edges shorter
    "neighbourhood_sizes": _sql("SELECT person, w1, w2, w3, coalesce(a, 0) - greatest(w1 - 1, 0) * w2 AS w4 FROM v3 LEFT JOIN (SELECT src, CAST(sum(w3) AS BIGINT) AS a FROM inner_edges JOIN v3 ON person = dst GROUP BY 1) ON src = person",
        "v1 AS (SELECT person, count(src) AS w1 FROM members LEFT JOIN inner_edges ON src = person GROUP BY 1)",
        "v2 AS (SELECT person, w1, coalesce(a, 0) - w1 AS w2 FROM v1 LEFT JOIN (SELECT src, CAST(sum(w1) AS BIGINT) AS a FROM inner_edges JOIN v1 ON person = dst GROUP BY 1) ON src = person)",
        "v3 AS (SELECT person, w1, w2, coalesce(a, 0) - greatest(w1 - 1, 0) * w1 AS w3 FROM v2 LEFT JOIN (SELECT src, CAST(sum(w2) AS BIGINT) AS a FROM inner_edges JOIN v2 ON person = dst GROUP BY 1) ON src = person)"),
    # paths of each length, level by level; a node between two ends carries its share of their paths
    "path_node_frequency": _sql("""SELECT b.node AS person, round(sum(a.n * b.n / c.n), 6) AS frequency FROM paths c JOIN paths b ON b.source = c.source AND b.dist < c.dist AND b.dist > 0
JOIN paths a ON a.source = b.node AND a.node = c.node AND a.dist + b.dist = c.dist WHERE c.source % 10 = 0 GROUP BY 1""",
        _INNER, "c0 AS (SELECT person AS source, person AS node, CAST(1 AS DOUBLE) AS n FROM members)",
        *(f"c{i} AS (SELECT c.source, e.dst AS node, sum(n) AS n FROM c{i - 1} c JOIN inner_edges e ON e.src = c.node JOIN dist d ON d.source = c.source AND d.node = e.dst AND d.dist = {i} GROUP BY 1, 2)" for i in range(1, 10)),
        "paths AS (" + " UNION ALL ".join(f"SELECT source, node, {i} AS dist, n FROM c{i}" for i in range(10)) + ")"),
    "q2_batch": _sql("SELECT query_no, topic AS name, size FROM sizes JOIN asked USING (query_no) QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY size DESC, topic) <= k", *_young(BATCH)),
    "q2_all_dates": _sql("SELECT query_no, topic AS name, size FROM sizes", *_young(DATES)),
    "q1_path_nofilter": _paths("knows", "SELECT src, dst FROM knows"),
    "q1_path_x0": _paths("talk", "SELECT src, dst FROM weights WHERE reply_min > 0"),
    "q1_path_x1": _paths("talk", "SELECT src, dst FROM weights WHERE reply_min > 1"),
    "q1_path_pairs": _sql("SELECT p1 AS query_no, CAST(CASE WHEN p1 = p2 THEN 0 ELSE coalesce(dist, -1) END AS INT) AS distance FROM asked LEFT JOIN dist ON source = p1 AND node = p2",
        _ASKED.format(edges="talk"), "walk(source, x, node, dist) AS (SELECT p1, x, p1, 0 FROM asked UNION SELECT source, x, dst, dist + 1 FROM walk JOIN weights e ON e.src = walk.node AND (x < 0 OR reply_min > x) WHERE dist < 14)", _DIST),
    # each node's smallest neighbour one step nearer to the source, followed back from the target
    "q1_path_nodes": _sql("SELECT query_no, step, person FROM trace", _ASKED.format(edges="knows"), "start AS (SELECT p1 AS person FROM asked)", _WALK.format(start="start", edges="knows", depth=5), _DIST.replace("AS", "AS MATERIALIZED", 1),
        "before AS MATERIALIZED (SELECT t.source, t.node, min(e.src) AS before FROM dist t JOIN knows e ON e.dst = t.node JOIN dist s ON s.source = t.source AND s.node = e.src AND s.dist + 1 = t.dist GROUP BY 1, 2)",
        "trace(query_no, step, person) AS (SELECT p1, dist, p2 FROM asked JOIN dist ON source = p1 AND node = p2 UNION ALL SELECT query_no, step - 1, before FROM trace JOIN before ON source = query_no AND node = person)"),
    "pairs_within_h": _sql("SELECT p1, p2, h, dist AS distance FROM asked JOIN dist ON source = p1 AND node = p2 WHERE dist <= h", _ASKED.format(edges="knows"), "start AS (SELECT p1 AS person FROM asked)", _WALK.format(start="start", edges="knows", depth=5), _DIST),
    "q2_topk": _sql("SELECT topic AS name, size FROM sizes ORDER BY size DESC, name LIMIT 8", _FANS),
    "q2_topk_pad": _sql("SELECT DISTINCT parts.topic AS name, coalesce(size, 0) AS size FROM parts LEFT JOIN sizes USING (topic) ORDER BY size DESC, name LIMIT 200", _FANS).replace(SINCE, "1998-01-01"),
    "q2_answer": _sql("SELECT coalesce(string_agg(name, ' ' ORDER BY size DESC, name), '') AS answer FROM (SELECT topic AS name, size FROM sizes ORDER BY size DESC, name LIMIT 5)", _FANS),
    "q3_nation_h1": _similar(20, 1, "NATION_3"),
    "q3_nation_h2": _similar(20, 2, "NATION_7"),
    "q3_region_h1": _similar(20, 1, "EUROPE"),
    "q3_unknown_place": _similar(5, 2, "Nowhere"),
    "q3_overlap_first": _similar(20, 2, "NATION_7"),
    "q3_overlap_h3": _similar(50, 3, "NATION_5"),
    "q3_chosen_plan": _similar(30, 3, "NATION_9"),
    "q3_answer": _similar(5, 1, "NATION_3", answer=True),
    "q4_topk": _sql("SELECT person, centrality FROM close_ ORDER BY centrality DESC, person LIMIT 10", _INNER, _SUMS, _ALL),
    "q4_topk_bounded": _sql("SELECT person, centrality FROM close_ ORDER BY centrality DESC, person LIMIT 10", _INNER, _SUMS, _ALL),
    "q4_answer": _sql("SELECT coalesce(string_agg(person, ' ' ORDER BY centrality DESC, person), '') AS answer FROM (SELECT person, centrality FROM close_ ORDER BY centrality DESC, person LIMIT 7)", _INNER, _SUMS, _ALL),
    "q4_drop_isolated": _sql("SELECT person, centrality FROM close_ ORDER BY centrality DESC, person LIMIT 10", _INNER, _SUMS, _SOCIAL),
    "graph_dump": _sql("SELECT 0 AS part, src AS a, CAST(0 AS BIGINT) AS b, CAST(src AS VARCHAR) AS line FROM (SELECT DISTINCT src FROM knows) UNION ALL SELECT 1, 0, 0, '#' UNION ALL SELECT 2, src, dst, src || ' ' || dst FROM knows WHERE src < dst"),
    "files_lines": _sql("SELECT * FROM lines", "away AS (SELECT person, place FROM located l WHERE place > (SELECT min(place) FROM located h WHERE h.person = l.person))",
        "lines(file, lines, broken) AS (" + " UNION ALL ".join(f"SELECT '{f}', ({n}), CAST(0 AS BIGINT)" for f, n in {
            "person": "SELECT count(*) FROM customer", "person_knows_person": "SELECT count(*) FROM knows", "comment_hasCreator_person": "SELECT 2 * count(*) FROM replies", "comment_replyOf_comment": "SELECT count(*) FROM replies",
            "person_hasInterest_tag": "SELECT count(*) FROM interest", "tag": "SELECT count(DISTINCT topic) FROM parts", "place": "SELECT count(*) FROM place", "place_isPartOf_place": "SELECT count(*) FROM part_of",
            "person_isLocatedIn_place": "SELECT count(DISTINCT person) FROM located", "organisation_isLocatedIn_place": "SELECT count(*) FROM place", "person_studyAt_organisation": "SELECT count(*) FROM away WHERE place % 2 = 0",
            "person_workAt_organisation": "SELECT count(*) FROM away WHERE place % 2 = 1", "forum_hasTag_tag": "SELECT count(*) FROM parts", "forum_hasMember_person": "SELECT count(*) FROM (SELECT DISTINCT l_partkey, o_custkey FROM bought)",
        }.items()) + ")"),
    "files_located": _sql("SELECT person, place FROM located"),
    "query_text_kinds": _sql("""SELECT 1 AS kind, p1 || '|' || p2 || '|' || x || '||||' AS parts FROM asked UNION ALL SELECT 2, '|||' || (id % 8 + 1) || '|' || birthday || '||' FROM person WHERE birthday IS NOT NULL
UNION ALL SELECT 3, '|||' || (id % 8 + 1) || '||' || (id % 7 + 1) || '|' || name FROM place UNION ALL SELECT DISTINCT 4, '|||3|||' || topic FROM parts""", _ASKED.format(edges="knows")),
    "query_text_parse": _sql("SELECT DISTINCT 4 AS kind, 3 AS k, topic AS name FROM parts"),
    "answer_parse": _sql("SELECT DISTINCT topic AS answer FROM parts"),
}


#: Read back from files, the same rows.
ORACLE_SQL |= {f"files_{name}": ORACLE_SQL[same] for name, same in {"reply_counts": "reply_counts", "interest_stats": "interest_stats", "q1_pairs": "q1_path_pairs", "q2_topk": "q2_topk", "q3_nation_h1": "q3_nation_h1", "q4_topk": "q4_topk"}.items()}


def _query(plan: Callable[[Network], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(read_star_schema(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in PLANS.items()}
