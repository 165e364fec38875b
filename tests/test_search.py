"""Searches, bounds and pairs on random graphs, against plain Python."""

import random
from collections import Counter, defaultdict, deque

import pytest

from kinfolk.operators import centrality, graph, overlap, search


def random_graph(seed, n, m, parts=1):
    """Edges over 0..n-1 that stay within `parts` classes of ids; ids spread out, so that they are not dense."""
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 20 * n), n)
    adjacent = defaultdict(set)
    while sum(map(len, adjacent.values())) < 2 * m:
        a, b = rng.sample(range(n), 2)
        if a % parts == b % parts:
            adjacent[ids[a]].add(ids[b])
            adjacent[ids[b]].add(ids[a])
    return ids, adjacent


def distances(adjacent, start, kept=lambda a, b: True):
    dist, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in adjacent.get(a, ()):
            if b not in dist and kept(a, b):
                dist[b] = dist[a] + 1
                queue.append(b)
    return dist


def frames(spark, ids, adjacent):
    edges = spark.createDataFrame([(a, b) for a in adjacent for b in adjacent[a]], "src long, dst long").repartition(3)
    return edges, spark.createDataFrame([(i,) for i in ids], "person long")


GRAPHS = [(2, 40, 90, 2)]


@pytest.mark.parametrize("seed, n, m, parts", GRAPHS)
def test_counts_bounds_and_sums(spark, seed, n, m, parts):
    ids, adjacent = random_graph(seed, n, m, parts)
    edges, nodes = frames(spark, ids, adjacent)
    dist = {i: distances(adjacent, i) for i in ids}
    want = {(i, level): c for i in ids for level, c in Counter(dist[i].values()).items()}
    assert {(r.person, r.level): r.c for r in search.level_counts(edges, nodes, nodes, pass_rows=70).collect()} == want
    cut = {key: c for key, c in want.items() if key[1] <= 2}
    assert {(r.person, r.level): r.c for r in search.level_counts(edges, nodes, nodes, depth=2).collect()} == cut
    for r in search.walk_counts(edges, nodes, 4).collect():
        assert all(w >= want.get((r.person, k), 0) for k, w in enumerate(r.walks, 1)) and r.walks[0] == len(adjacent[r.person])
    for r in search.hop_counts(edges, nodes, 3).collect():
        assert [r.h1, r.h2, r.h3] == [sum(0 < d <= h for d in dist[r.person].values()) for h in (1, 2, 3)]
    sums = search.sums_of(search.level_counts(edges, nodes, nodes))
    assert {r.person: (r.r, r.s) for r in sums.collect()} == {i: (len(d), sum(d.values())) for i, d in dist.items()}
    assert {(r.dist, r.pairs) for r in centrality.distance_histogram(edges, nodes).collect()} == set(Counter(d for i in ids for d in dist[i].values()).items())
    work = search.Work()
    assert [r.diameter for r in centrality.diameter(edges, nodes, work=work).collect()] == [max(d for i in ids for d in dist[i].values())]
    assert work.searched < n
    comps = {r.node: r.comp for r in graph.components(edges, nodes).collect()}
    assert comps == {i: min(dist[i]) for i in ids}


@pytest.mark.parametrize("seed, n, m, parts", GRAPHS)
def test_most_central_by_bounds(spark, seed, n, m, parts):
    ids, adjacent = random_graph(seed, n, m, parts)
    edges, nodes = frames(spark, [*ids, 10**9], adjacent)  # and one without friends
    total = n + 1

    def close(i):
        d = distances(adjacent, i)
        s = sum(d.values())
        return float((len(d) - 1) ** 2) / (float(total - 1) * s) if s else 0.0

    want = sorted(((close(i), i) for i in [*ids, 10**9]), key=lambda x: (-x[0], x[1]))
    for k, block in ((5, 12), (total + 5, 80)):
        work = search.Work()
        got = centrality.most_central(edges, nodes, k, depth=4, block=block, work=work).collect()
        assert [(r.centrality, r.person) for r in got] == want[:k]
        assert work.searched <= total


def test_fewer_searches_than_members(spark):
    ids, adjacent = random_graph(9, 400, 1000)
    edges, nodes = frames(spark, ids, adjacent)
    work = search.Work()
    centrality.most_central(edges, nodes, 5, block=32, work=work).collect()
    assert work.searched <= len(ids) / 3


def test_ties_and_nothing(spark):
    ring = {i: {(i + 1) % 6, (i - 1) % 6} for i in range(6)}
    edges, nodes = frames(spark, range(6), ring)
    assert [r.person for r in centrality.most_central(edges, nodes, 4, block=2).collect()] == [0, 1, 2, 3]
    none = nodes.where("false")
    assert centrality.most_central(edges.where("false"), none, 4).collect() == []
    assert [r.diameter for r in centrality.diameter(edges.where("false"), none).collect()] == [None]
    assert search.level_counts(edges, nodes, none).collect() == []
    assert graph.components(edges.where("false"), nodes).count() == 6


@pytest.mark.parametrize("seed, n, m, parts", GRAPHS)
def test_pairs_from_both_ends(spark, seed, n, m, parts):
    ids, adjacent = random_graph(seed, n, m, parts)
    rng = random.Random(seed)
    weight = {}
    for a in adjacent:
        for b in adjacent[a]:
            weight[a, b] = weight[b, a] = weight.get((b, a), rng.randrange(5))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, reply_min long").repartition(3)
    asked = [(q, rng.choice(ids), rng.choice(ids), rng.randrange(-1, 5), rng.choice([None, None, *range(8)])) for q in range(60)] + [(60, ids[0], ids[0], 3, 0), (61, ids[0], -999, -1, None), (62, -999, ids[0], -1, None)]
    pairs = spark.createDataFrame(asked, "query_no long, p1 long, p2 long, x int, h int")
    got = {r.query_no: r.distance for r in search.meet(edges, pairs).collect()}
    want = {}
    for q, a, b, x, h in asked:
        d = distances(adjacent, a, lambda u, v, x=x: x < 0 or weight[u, v] > x).get(b, -1)
        want[q] = -1 if h is not None and d > h else d
    assert got == want
    assert search.meet(edges, pairs.where("false")).collect() == []


def test_two_frontiers_are_smaller_than_one(spark):
    ids, adjacent = random_graph(5, 600, 1500)
    edges, _ = frames(spark, ids, adjacent)
    rng = random.Random(1)
    asked = spark.createDataFrame([(q, rng.choice(ids), rng.choice(ids), -1, None) for q in range(30)], "query_no long, p1 long, p2 long, x int, h int")
    work = search.Work()
    search.meet(edges.selectExpr("src", "dst", "0L AS reply_min"), asked, work).collect()
    one_sided = graph.reach(edges, asked.selectExpr("p1 AS person"), wanted=asked.selectExpr("p1 AS source", "p2 AS node")).count()
    assert work.rows < one_sided / 2


@pytest.mark.parametrize("seed, n, m, parts", GRAPHS)
def test_paths_with_their_nodes(spark, seed, n, m, parts):
    ids, adjacent = random_graph(seed, n, m, parts)
    edges, _ = frames(spark, ids, adjacent)
    rng = random.Random(seed)
    asked = [(q, rng.choice(ids), rng.choice(ids)) for q in range(40)] + [(40, ids[0], ids[0]), (41, ids[0], -999)]
    paths = defaultdict(list)
    for r in sorted(search.path_nodes(edges, spark.createDataFrame(asked, "query_no long, p1 long, p2 long")).collect()):
        paths[r.query_no].append(r.person)
    for q, a, b in asked:
        dist = distances(adjacent, a)
        if b not in dist:
            assert q not in paths
            continue
        want = [b]
        while want[-1] != a:
            want.append(min(v for v in adjacent[want[-1]] if dist.get(v) == dist[want[-1]] - 1))
        assert paths[q] == want[::-1]


def test_frequency_of_nodes_on_shortest_paths(spark):
    ids, adjacent = random_graph(4, 40, 60)
    edges, _ = frames(spark, ids, adjacent)
    chosen = ids[:9]
    count = {}
    for a in ids:
        dist, c = distances(adjacent, a), defaultdict(int)
        c[a] = 1
        for v in sorted(dist, key=dist.get):
            for u in adjacent[v]:
                if dist.get(u) == dist[v] + 1:
                    c[u] += c[v]
        count[a] = (dist, c)
    want = defaultdict(float)
    for s in chosen:
        dist, c = count[s]
        for t in dist:
            for v in dist:
                if v not in (s, t) and t in count[v][0] and dist[v] + count[v][0][t] == dist[t]:
                    want[v] += c[v] * count[v][1][t] / c[t]
    got = {r.person: r.frequency for r in centrality.path_frequency(edges, spark.createDataFrame([(i,) for i in chosen], "person long")).collect()}
    assert got == pytest.approx(dict(want))


@pytest.mark.parametrize("seed, hops, k", [(2, 2, 400)])
def test_overlap_first(spark, seed, hops, k):
    ids, adjacent = random_graph(seed, 40, 70, 2)
    edges, nodes = frames(spark, ids, adjacent)
    rng = random.Random(seed)
    tags = {i: {int(rng.paretovariate(0.7)) % 25 for _ in range(rng.randrange(6))} for i in ids}
    interest = spark.createDataFrame([(i, t) for i in ids for t in tags[i]] * 2, "person long, tag long")
    members = rng.sample(ids, 30)
    want = sorted((-len(tags[a] & tags[b]), a, b) for a in members for b in members if a < b and distances(adjacent, a).get(b, 99) <= hops)[:k]
    frame = spark.createDataFrame([(i,) for i in members], "person long")
    got = overlap.overlap_first(edges, interest, frame, k, hops).collect()
    assert [(-r.common, r.a, r.b) for r in got] == want
    far, shared = overlap.costs(edges, interest, frame, hops)
    assert far > 0 and shared >= sum(1 for a in members for b in members if a < b and tags[a] & tags[b])


def test_pairs_that_share_enough(spark):
    rng = random.Random(8)
    tags = {i: {int(rng.paretovariate(0.8)) % 30 for _ in range(rng.randrange(12))} for i in range(60)}
    of = spark.createDataFrame([(i, t) for i in tags for t in tags[i]], "person long, tag long")
    for least, below in ((1, None), (2, 4)):
        got = {(r.a, r.b): r.common for r in overlap.sharing_at_least(of, least, below).collect()}
        both = {(a, b): len(tags[a] & tags[b]) for a in tags for b in tags if a < b}
        assert got == {p: c for p, c in both.items() if c >= least and (below is None or c < below)}


def test_stars_of_a_few_nodes_at_a_time(spark):
    ids, adjacent = random_graph(6, 120, 130, 3)
    edges, nodes = frames(spark, ids, adjacent)
    whole = {i: min(distances(adjacent, i)) for i in ids}
    stars = graph.contracted(edges, nodes=16)
    assert {r.node: r.comp for r in graph.components(stars, nodes).collect()} == whole
    keyed = edges.selectExpr("1 AS q", "src", "dst").union(edges.where("src % 2 = 0 AND dst % 2 = 0").selectExpr("2", "src", "dst"))
    rows = nodes.selectExpr("1 AS q", "person").union(nodes.where("person % 2 = 0").selectExpr("2", "person"))
    even = {a: {b for b in adjacent[a] if b % 2 == 0} for a in adjacent if a % 2 == 0}
    got = {(r.q, r.node): r.comp for r in graph.components(keyed, rows, ("q",)).collect()}
    assert got == {(1, i): c for i, c in whole.items()} | {(2, i): min(distances(even, i)) for i in ids if i % 2 == 0}


def test_forests_join_what_all_edges_join(spark):
    ids, adjacent = random_graph(7, 50, 160, 2)
    rng = random.Random(7)
    weight = {(a, b): rng.randrange(12) for a in adjacent for b in adjacent[a] if a < b}
    rows = [(q, a, b, w) for q in (1, 2) for (a, b), w in weight.items() if q == 1 or a % 2]
    edges = spark.createDataFrame(rows, "q int, src long, dst long, weight int").repartition(5)
    whole = [tuple(r) for r in graph.thinned(edges, ("q",)).collect()]
    cut = [tuple(r) for r in graph.thinned(edges, ("q",), nodes=30).collect()]
    assert len(whole) < len(cut) <= len(rows)
    for kept in (whole, cut):
        assert set(kept) <= set(rows)
        for q in (1, 2):
            for least in range(13):
                some, every = (defaultdict(set), defaultdict(set))
                for held, out in ((kept, some), (rows, every)):
                    for k, a, b, w in held:
                        if k == q and w >= least:
                            out[a].add(b)
                            out[b].add(a)
                assert all(set(distances(some, i)) == set(distances(every, i)) for i in ids)
    assert sum(q == 1 for q, *_ in whole) == len(ids) - len({min(distances(adjacent, i)) for i in ids})
