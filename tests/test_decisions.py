"""One test for each decision on what the queries mean (thresholds, ties, unknown names, sparse ids, files), on networks made by hand or drawn at random."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from kinfolk import cli
from kinfolk.functions import text
from kinfolk.operators import centrality, graph
from kinfolk.plans import social
from kinfolk.sources.network import SCHEMAS, Network, read_folder, symmetric

BIG = 10**12  # ids need not be dense


def network(spark, knows=(), replies=(), persons=(), interest=(), tags=(), places=(), part_of=(), located=(), forum_tag=(), forum_member=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Network(
        person=frame(persons, "id long, birthday date"), knows=symmetric(frame(knows, "src long, dst long")), replies=frame(replies, "src long, dst long"), interest=frame(interest, "person long, tag long").distinct(),
        tag=frame(tags, "id long, name string"), place=frame(places, "id long, name string"), part_of=frame(part_of, "child long, parent long"), located=frame(located, "person long, place long").distinct(),
        forum_tag=frame(forum_tag, "forum long, tag long").distinct(), forum_member=frame(forum_member, "forum long, person long").distinct(),
    )


def asked(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_no long, p1 long, p2 long, x int")


def distances(spark, net, *rows):
    return [r.distance for r in social.shortest_paths(net, asked(spark, *rows)).orderBy("query_no").collect()]


def names(top):
    return text.joined(top, F.col("name"), -F.col("size"), F.col("name")).first().answer


def test_d1_thresholds_are_strict_and_d2_counts_do_not_wrap_and_d16_ids_are_sparse(spark):
    net = network(spark, knows=[(7, BIG)], replies=[(7, BIG)] * 300 + [(BIG, 7)] * 257)
    assert distances(spark, net, (7, BIG, 256), (BIG, 7, 257), (7, BIG, -1), (7, 7, 999), (7, 8, -1)) == [1, -1, 1, 0, -1]


def test_d3_dates_are_inclusive_and_d4_empty_ranges_are_left_out(spark):
    net = network(spark, persons=[(1, date(1990, 5, 5)), (2, date(1990, 5, 6)), (3, None)], interest=[(1, 10), (2, 10), (2, 11), (3, 12)], tags=[(10, "B"), (11, "A"), (12, "C"), (13, "D")], knows=[(1, 2)])
    assert names(social.top_interests(net, 9, "1990-05-05")) == "B A"
    assert names(social.top_interests(net, 9, "1990-05-06")) == "A B"
    assert names(social.top_interests(net, 9, "1990-05-05", include_empty=True)) == "B A C D"
    assert names(social.top_interests(net, 9, "2000-01-01")) == ""


def test_d5_isolated_members_d6_formula_d8_ties_and_d15_tags_of_one_name(spark):
    # a path 1-2-3, a pair 4-5 and 6 alone, in forums of two tags with the same name
    net = network(spark, knows=[(1, 2), (2, 3), (4, 5), (6, 99)], tags=[(10, "T"), (11, "T"), (12, "U")], forum_tag=[(1, 10), (2, 11), (3, 12)], forum_member=[(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (2, 6), (3, 99)])
    got = [tuple(r) for r in social.top_central(net, 9, "T").collect()]
    assert got == [(2, 4 / 10), (1, pytest.approx(4 / 15)), (3, pytest.approx(4 / 15)), (4, 1 / 5), (5, 1 / 5), (6, 0.0)]
    assert [r.person for r in social.top_central(net, 9, "T", drop_isolated=True).collect()] == [2, 1, 3, 4, 5]
    assert [tuple(r) for r in social.top_central_bounded(net, 4, "T").collect()] == got[:4]


def test_d7_every_member_is_ranked_exactly(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    net = network(spark, knows=edges, tags=[(1, "T")], forum_tag=[(1, 1)], forum_member=[(1, i) for i in range(25)])
    sums = {r.person: (r.r, r.s) for r in centrality.masked_sums(net.knows, spark.range(25).withColumnRenamed("id", "person")).collect()}
    want = sorted((-((r - 1) ** 2) / (24 * s) if s else 0.0, i) for i, (r, s) in sums.items())
    got = [(-r.centrality, r.person) for r in social.top_central(net, 25, "T").collect()]
    assert [i for _, i in got] == [i for _, i in want] and [c for c, _ in got] == pytest.approx([c for c, _ in want])


def test_d9_names_end_with_the_last_bracket_and_d11_kinds_are_filtered_and_d10_answers_in_input_order(spark):
    lines = ["query4(2, A (odd), name) % comment", "query3(2, 1,B)", "query4(2, plain)"]
    rows = text.parsed(spark.createDataFrame(list(enumerate(lines)), "query_no long, value string"))
    assert [r["name"] for r in rows.orderBy("query_no").collect()] == ["A (odd), name", "B", "plain"]
    net = network(spark, tags=[(1, "plain"), (2, "A (odd), name")], forum_tag=[(1, 1), (2, 2)], forum_member=[(1, 4), (2, 5)], places=[(1, "B")])
    assert cli.answers(net, rows) == ["5", "", "4"]
    assert cli.answers(net, rows.where("kind = 4")) == ["5", "4"]


def test_d12_no_interests_and_d13_unknown_names_and_d14_places_without_parents(spark):
    net = network(spark, knows=[(1, 2), (2, 3)], interest=[(1, 10)], places=[(5, "Lone"), (6, "Top"), (7, "In")], part_of=[(7, 6)], located=[(1, 5), (2, 5), (3, 7)])
    for plan in ("reach", "overlap"):
        assert [tuple(r) for r in social.similar_pairs(net, 3, 1, "Lone", plan).collect()] == [(1, 2, 0)]
        assert social.similar_pairs(net, 3, 1, "Nowhere", plan).collect() == []
    assert [r.person for r in social.persons_in_place(net, "Top").collect()] == [3]
    assert social.top_central(net, 3, "Unknown").collect() == [] and social.top_central_bounded(net, 3, "Unknown").collect() == []


def test_d17_one_way_rows_and_d18_replies_far_apart(spark, tmp_path):
    rows = {name: [] for name in SCHEMAS}
    rows["person_knows_person"] = [(1, 2), (3, 2), (2, 3), (3, 3)]
    rows["comment_hasCreator_person"] = [(10, 1), (5_000_000, 2), (20, 2), (9_000_000, 1)]
    rows["comment_replyOf_comment"] = [(5_000_000, 10), (9_000_000, 20)]
    for name, held in rows.items():
        (tmp_path / f"{name}.csv").write_text("header\n" + "".join("|".join(map(str, r)) + "\n" for r in held))
    net = read_folder(spark, str(tmp_path))
    assert sorted(map(tuple, net.knows.collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert sorted(map(tuple, graph.reply_counts(net.replies).collect())) == [(1, 2, 1), (2, 1, 1)]


def test_random_queries_of_all_kinds(spark):
    """Answers over a random network, each against plain Python; k 1 to 8, h 1 to 3, x -1 to 2."""
    rng = random.Random(11)
    people = rng.sample(range(1000), 24)
    edges = {tuple(sorted(rng.sample(people, 2))) for _ in range(40)}
    near = {p: {b if a == p else a for a, b in edges if p in (a, b)} for p in people}
    replies = [tuple(rng.sample(e, 2)) for e in edges for _ in range(rng.randrange(9))]
    born = {p: date(rng.randrange(1980, 2001), rng.randrange(1, 13), rng.randrange(1, 29)) for p in people}
    likes = {p: {t for t in range(6) if rng.random() < 0.4} for p in people}
    homes = {p: rng.choice([0, 1, 2]) for p in people}
    net = network(spark, knows=edges, replies=replies, persons=born.items(), interest=[(p, t) for p in people for t in likes[p]], tags=[(t, f"tag{t}") for t in range(6)], places=[(0, "Top"), (1, "In"), (2, "Out")], part_of=[(1, 0)], located=homes.items())

    def walk(start, ok):
        dist, level = {start: 0}, [start]
        while level:
            level = [v for u in level for v in near[u] if ok(u, v) and dist.setdefault(v, dist[u] + 1) == dist[u] + 1 and v not in level]
        return dist

    count = lambda a, b: sum(r == (a, b) for r in replies)
    pairs = [(*rng.sample(people, 2), rng.randrange(-1, 3)) for _ in range(12)]
    want = [walk(a, lambda u, v, x=x: x < 0 or min(count(u, v), count(v, u)) > x).get(b, -1) for a, b, x in pairs]
    assert distances(spark, net, *pairs) == want
    since = date(1990, 1, 1)
    fans = {t: {p for p in people if t in likes[p] and born[p] >= since} for t in range(6)}
    sizes = {t: max((len(walk(p, lambda u, v, t=t: v in fans[t])) for p in fans[t]), default=0) for t in fans}
    ranked = sorted((t for t in fans if sizes[t]), key=lambda t: (-sizes[t], f"tag{t}"))
    assert names(social.top_interests(net, 4, "1990-01-01")) == " ".join(f"tag{t}" for t in ranked[:4])
    inside = [p for p in people if homes[p] in (0, 1)]
    similar = sorted((-len(likes[a] & likes[b]), a, b) for a in inside for b in inside if a < b and walk(a, lambda u, v: True).get(b, 99) <= 2)
    for plan in ("reach", "overlap"):
        assert [(-r.common, r.a, r.b) for r in social.similar_pairs(net, 8, 2, "Top", plan).collect()] == similar[:8]
