"""The hand-checkable network: files in, answers out."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import text
from kinfolk.operators import centrality, graph
from kinfolk.plans import social
from kinfolk.sources import network
from kinfolk.sources.network import read_folder

BIRTHDAYS = ["1980-01-01", "1985-05-05", "1990-02-02", "1979-12-31", "1991-01-01", "1992-01-01"]
REPLIES = [(0, 1)] * 2 + [(1, 0), (1, 2), (2, 1), (0, 2)] + [(2, 3)] * 3 + [(3, 2)] * 2 + [(3, 4), (1, 1), (0, 5)]


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("network")
    creator, reply = [], []
    for i, (a, b) in enumerate(REPLIES):
        creator += [(20 * i, b), (20 * i + 10, a)]
        reply.append((20 * i + 10, 20 * i))
    files = {
        "person": [(i, "f", "l", "x", d) for i, d in enumerate(BIRTHDAYS)],
        "person_knows_person": [(0, 1), (1, 0), (1, 2), (0, 2), (2, 0), (2, 3), (3, 4), (4, 3)],
        "comment_hasCreator_person": creator,
        "comment_replyOf_comment": reply,
        "person_hasInterest_tag": [(0, 10), (0, 20), (1, 10), (2, 10), (2, 20), (3, 20), (4, 20), (4, 30), (5, 30)],
        "tag": [(10, "Alpha"), (20, "Beta"), (30, "Gamma"), (40, "Delta")],
        "place": [(0, "Asia"), (1, "China"), (2, "Pudong"), (3, "Europe"), (4, "Pudong")],
        "place_isPartOf_place": [(1, 0), (2, 1), (4, 3)],
        "person_isLocatedIn_place": [(0, 2), (1, 1), (2, 2), (3, 4), (4, 3), (5, 4)],
        "organisation_isLocatedIn_place": [(0, 1), (10, 3)],
        "person_studyAt_organisation": [(3, 10, 2001)],
        "person_workAt_organisation": [(4, 0, 2005)],
        "forum_hasTag_tag": [(100, 10), (200, 10), (200, 20)],
        "forum_hasMember_person": [(f, p, "2010") for f, ps in ((100, (0, 1, 2)), (200, (3, 5))) for p in ps],
    }
    for name, rows in files.items():
        (folder / f"{name}.csv").write_text("header\n" + "".join("|".join(map(str, r)) + "\n" for r in rows))
    return read_folder(spark, str(folder))


def test_shortest_paths(spark, net):
    asked = [(0, 4, -1, 3), (0, 3, 0, 3), (0, 3, 1, -1), (0, 0, 5, 0), (0, 4, 0, -1), (2, 3, 1, 1), (2, 3, 2, -1), (0, 5, -1, -1)]
    rows = spark.createDataFrame([(i, a, b, x) for i, (a, b, x, _) in enumerate(asked)], "query_no long, p1 long, p2 long, x int")
    got = {r.query_no: r.distance for r in social.shortest_paths(net, rows).collect()}
    assert got == {i: d for i, (*_, d) in enumerate(asked)}


@pytest.mark.parametrize("k, since, empty, want", [(3, "1980-01-01", False, "Alpha Beta Gamma"), (2, "1980-01-02", False, "Alpha Beta"), (4, "1980-01-01", True, "Alpha Beta Gamma Delta"), (4, "1980-01-01", False, "Alpha Beta Gamma"), (2, "1990-02-02", False, "Alpha Beta")])
def test_interests(net, k, since, empty, want):
    top = social.top_interests(net, k, since, empty)
    assert text.joined(top, F.col("name"), -F.col("size"), F.col("name")).first().answer == want


@pytest.mark.parametrize("k, h, place, want", [(3, 2, "China", "0|2 0|1 1|2"), (4, 2, "China", "0|2 0|1 1|2 2|4"), (3, 1, "Pudong", "0|2 2|3"), (2, 1, "Nowhere", "")])
def test_similar_pairs(net, k, h, place, want):
    top = social.similar_pairs(net, k, h, place)
    assert text.joined(top, F.concat_ws("|", "a", "b"), -F.col("common"), F.col("a"), F.col("b")).first().answer == want


@pytest.mark.parametrize("name, drop, want", [("Alpha", False, [(2, 0.75), (0, 0.5625), (1, 0.5625), (3, 0.45), (5, 0.0)]), ("Alpha", True, [(2, 1.0), (0, 0.75), (1, 0.75), (3, 0.6)]), ("Beta", False, [(3, 0.0), (5, 0.0)]), ("Beta", True, []), ("Nothing", False, [])])
def test_central_members(net, name, drop, want):
    got = [(r.person, r.centrality) for r in social.top_central(net, 5, name, drop).collect()]
    assert [p for p, _ in got] == [p for p, _ in want]
    assert [c for _, c in got] == pytest.approx([c for _, c in want])


def test_query_text(spark):
    lines = ["query1(1, 2, -1)", "query2(3, 1980-02-01)", "query3(4, 2, Some_(odd) Place)", "query4(5, Tag)", "", "nonsense"]
    rows = text.parsed(spark.createDataFrame(list(enumerate(lines)), "query_no long, value string")).orderBy("query_no").collect()
    assert [(r.kind, r.p1, r.p2, r.x, r.k, str(r.d) if r.d else None, r.h, r.name) for r in rows] == [
        (1, 1, 2, -1, None, None, None, None), (2, None, None, None, 3, "1980-02-01", None, None), (3, None, None, None, 4, None, 2, "Some_(odd) Place"), (4, None, None, None, 5, None, None, "Tag"),
    ]
    answers = spark.createDataFrame([("1|2 3|4 % why",), (" % empty",), ("-1",)], "line string").select(text.answer_of(F.col("line")).alias("a"))
    assert [r.a for r in answers.collect()] == ["1|2 3|4", "", "-1"]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    both = edges.union(edges.select("dst", "src"))
    nodes = spark.range(62).select(F.col("id").alias("person"))
    assert {(r.comp, r["count"]) for r in graph.components(both, nodes).groupBy("comp").count().collect()} == {(0, 61), (61, 1)}


def test_answers_come_in_input_order(spark, net):
    from kinfolk import cli

    lines = ["query4(2, Alpha)", "query1(0, 4, -1)", "query3(3, 2, China)", "query2(2, 1980-01-02)", "query1(0, 3, 1)", "query2(3, 1980-01-01)", "query2(3, 2030-01-01)"]
    asked = text.parsed(spark.createDataFrame(list(enumerate(lines)), "query_no long, value string"))
    assert cli.answers(net, asked) == ["2 0", "3", "0|2 0|1 1|2", "Alpha Beta", "-1", "Alpha Beta Gamma", ""]


def test_both_ways_to_sum_distances_agree(spark):
    rows = spark.createDataFrame([(i, (i * i + 3 * i) % 150) for i in range(140)] + [(i, i + 1) for i in range(0, 100, 3)], "src long, dst long").where("src <> dst")
    edges = rows.union(rows.select("dst", "src")).distinct()
    nodes = spark.range(155).select(F.col("id").alias("person"))
    a, b = (sorted(map(tuple, centrality.distance_sums(edges, nodes, n).collect())) for n in (10_000, 0))
    assert a == b and len(a) == 155


def test_files_written_and_read_back(spark, net, tmp_path):
    again = read_folder(spark, network.write_folder(net, f"file://{tmp_path}/files"))
    for name in ("person", "knows", "replies", "interest", "tag", "place", "part_of", "located", "forum_tag", "forum_member"):
        before, after = (sorted(map(tuple, getattr(n, name).collect()), key=repr) for n in (net, again))
        assert before == after, name


def test_broken_lines_are_counted(spark, net, tmp_path):
    folder = network.write_folder(net, f"file://{tmp_path}/files")
    with open(f"{tmp_path}/files/person_knows_person.csv/more.csv", "w") as f:
        f.write("header\n1|x\n7\n|\n3|4|extra\n")
    with open(f"{tmp_path}/files/person.csv/more.csv", "w") as f:
        f.write("header\n77|a|b|c|1980-13-45\n78|a|b|c|\n79|a|b|c|1980-02-03\n")
    counts = {r.file: (r.lines, r.broken) for r in network.broken_lines(spark, folder).collect()}
    assert counts["person_knows_person"] == (10 + 4, 3) and counts["person"] == (6 + 3, 1)
    assert all(broken == 0 for name, (_, broken) in counts.items() if name not in ("person_knows_person", "person"))


def test_replies_of_pairs(spark, net):
    pairs = spark.createDataFrame([(0, 0, 1), (1, 3, 2), (2, 3, 4), (3, 4, 3), (4, 0, 5), (5, 1, 1), (6, 9, 8)], "query_no long, p1 long, p2 long")
    got = {r.query_no: (r.forth, r.back) for r in graph.replies_between(net.replies, pairs).collect()}
    assert got == {0: (2, 1), 1: (2, 3), 2: (1, 0), 3: (0, 1), 4: (1, 0), 5: (0, 0), 6: (0, 0)}


def test_graph_dump(net):
    lines = [r.line for r in text.dumped(net.knows).orderBy("part", "a", "b").collect()]
    assert lines == ["0", "1", "2", "3", "4", "#", "0 1", "0 2", "1 2", "2 3", "3 4"]


def test_both_plans_of_similar_pairs_agree(net):
    rows = [[tuple(r) for r in social.similar_pairs(net, 4, 2, "China", plan).collect()] for plan in ("reach", "overlap", None)]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_bounded_search_of_the_micro_network(net):
    for name in ("Alpha", "Beta"):
        a, b = ([tuple(r) for r in f(net, 5, name).collect()] for f in (social.top_central, social.top_central_bounded))
        assert a == b


def test_estimates_and_the_kth_value(spark):
    e = spark.createDataFrame([(1, 10.0), (2, 22.0), (3, 5.0), (4, 0.0)], "person long, estimate double")
    s = spark.createDataFrame([(1, 10), (2, 20), (3, 10), (4, 0)], "person long, s long")
    assert tuple(centrality.estimate_error(e, s).first()) == (3, pytest.approx(0.2), 2)
    assert [centrality.kth_largest(e, "estimate", k).first().value for k in (1, 2, 9)] == [22.0, 10.0, 0.0]
    assert centrality.kth_largest(e.where("false"), "estimate", 2).first().value is None
