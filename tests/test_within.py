"""Searches inside tasks and by joins, of graphs of several components, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_search import distances, frames, random_graph

from kinfolk.operators import centrality, search, within


def parts_of(seed, *sizes):
    """Components of very different sizes, a star of more neighbours than are read by columns, and nodes without any."""
    ids, adjacent = [], {}
    for i, (n, m) in enumerate(sizes):
        some, near = random_graph(seed + i, n, m)
        ids += [10_000 * i + a for a in some]
        adjacent |= {10_000 * i + a: {10_000 * i + b for b in near[a]} for a in near}
    hub, leaves = 10**9, range(10**9 + 1, 10**9 + 50)
    adjacent |= {hub: set(leaves)} | {a: {hub} for a in leaves}
    return [*ids, hub, *leaves, -10**6], adjacent


SIZES = [(150, 260), (40, 60), (8, 9)]
#: All components in tasks, the large one by joins, all by joins.
TASK_EDGES = (within.TASK_EDGES, 150, 0)


@pytest.mark.parametrize("task_edges", TASK_EDGES)
def test_f1_counts_of_each_level(spark, task_edges):
    ids, adjacent = parts_of(3, *SIZES)
    edges, nodes = frames(spark, ids, adjacent)
    for sources in (ids, ids[::3]):
        want = {(i, level): c for i in sources for level, c in Counter(distances(adjacent, i).values()).items()}
        some = spark.createDataFrame([(i,) for i in sources], "person long")
        assert {(r.person, r.level): r.c for r in search.level_counts(edges, nodes, some, task_edges=task_edges).collect()} == want


def test_f1_rows_do_not_grow_with_the_square_of_the_components(spark, monkeypatch):
    ids, adjacent = parts_of(5, *[(40, 70)] * 12)
    edges, nodes = frames(spark, ids, adjacent)
    rows, save = [], search.save
    monkeypatch.setattr(search, "save", lambda df: rows.append((out := save(df)).count()) or out)
    got = {(r.dist, r.pairs) for r in centrality.distance_histogram(edges, nodes).collect()}
    want = Counter(d for i in ids for d in distances(adjacent, i).values())
    assert got == set(want.items())
    assert sum(rows) <= len(ids) * (max(want) + 3)


def test_a_component_dealt_to_several_tasks(spark, monkeypatch):
    ids, adjacent = parts_of(4, *SIZES)
    edges, nodes = frames(spark, ids, adjacent)
    monkeypatch.setattr(within, "TASK_WORK", 200)
    for sources in (ids, ids[::2]):
        want = {(i, level): c for i in sources for level, c in Counter(distances(adjacent, i).values()).items()}
        some = spark.createDataFrame([(i,) for i in sources], "person long")
        assert {(r.person, r.level): r.c for r in search.level_counts(edges, nodes, some).collect()} == want


@pytest.mark.parametrize("task_edges", TASK_EDGES)
def test_f5_sums_of_a_sample_by_source_and_by_node(spark, task_edges):
    ids, adjacent = parts_of(6, *SIZES)
    edges, nodes = frames(spark, ids, adjacent)
    chosen = ids[::4]
    dist = {i: distances(adjacent, i) for i in chosen}
    own, met = search.both_sums(edges, nodes, nodes.where(F.col("person").isin(chosen)), task_edges=task_edges)
    assert {r.person: r.s for r in own.collect()} == {i: sum(d.values()) for i, d in dist.items()}
    seen = {v: [d[v] for d in dist.values() if v in d] for v in ids}
    assert {r.person: (r.n, r.s) for r in met.collect()} == {v: (len(d), sum(d)) for v, d in seen.items() if d}


@pytest.mark.parametrize("task_edges", TASK_EDGES[:2])
def test_f4_frequencies(spark, task_edges):
    ids, adjacent = parts_of(8, *SIZES)
    edges, _ = frames(spark, ids, adjacent)
    chosen = spark.createDataFrame([(i,) for i in ids[::5]], "person long")
    want = {r.person: r.frequency for r in centrality._frequency(edges, chosen).collect()}
    assert {r.person: r.frequency for r in centrality.path_frequency(edges, chosen, task_edges).collect()} == pytest.approx(want)


@pytest.mark.parametrize("task_edges", TASK_EDGES[:2])
def test_f6_diameter_of_the_farthest_component(spark, task_edges):
    ids, adjacent = parts_of(2, *SIZES)
    edges, nodes = frames(spark, ids, adjacent)
    work = search.Work()
    want = max(d for i in ids for d in distances(adjacent, i).values())
    assert centrality.diameter(edges, nodes, work=work, task_edges=task_edges).first().diameter == want
    assert work.searched < len(ids) / 2
    if task_edges == within.TASK_EDGES:
        assert work.rounds == 0  # none by joins


@pytest.mark.parametrize("task_edges", TASK_EDGES[:2])
def test_f7_paths_within_components(spark, task_edges):
    ids, adjacent = parts_of(7, *SIZES)
    edges, _ = frames(spark, ids, adjacent)
    asked = [(q, ids[(q * 37) % len(ids)], ids[(q * q + 5) % len(ids)]) for q in range(300)] + [(300, ids[0], ids[0]), (301, -999, -999), (302, ids[0], -999)]
    want = set()
    for q, a, b in asked:
        dist = distances(adjacent, a)
        while b in dist:
            want.add((q, dist[b], b))
            b = min((v for v in adjacent.get(b, ()) if dist[v] == dist[b] - 1), default=None)
    got = [tuple(r) for r in search.path_nodes(edges, spark.createDataFrame(asked, "query_no long, p1 long, p2 long"), task_edges).collect()]
    assert len(got) == len(want) and set(got) == want
