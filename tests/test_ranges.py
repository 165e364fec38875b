"""Largest groups of each tag for many dates, inside tasks and by forests, against the ranges of one date at a time."""

import random
from datetime import date, timedelta

import pytest
from test_decisions import network

from kinfolk.operators import graph, within
from kinfolk.plans import social


def drawn(spark, seed, people=60, tags=5):
    rng = random.Random(seed)
    born = {p: date(1990, 1, 1) + timedelta(days=rng.randrange(60)) for p in range(people)}
    born[people] = None
    knows = {tuple(sorted(rng.sample(range(people), 2))) for _ in range(people * 2)}
    interest = [(p, t) for p in range(people + 1) for t in range(tags) if rng.random() < 0.5]
    return network(spark, knows=knows, persons=born.items(), interest=interest), knows, born, interest


def sizes(knows, fans):
    """The largest group of each tag's fans, by searches."""
    out = {}
    for tag, people in fans.items():
        left = set(people)
        while left:
            group, stack = set(), [left.pop()]
            while stack:
                p = stack.pop()
                group.add(p)
                stack += [q for a, b in knows for q in ((b,) if a == p else (a,) if b == p else ()) if q in left]
                left -= set(stack)
            out[tag] = max(out.get(tag, 0), len(group))
    return out


@pytest.mark.parametrize("task_edges", [within.TASK_EDGES, 0])
def test_f8_f10_ranges_of_many_dates(spark, monkeypatch, task_edges):
    net, knows, born, interest = drawn(spark, 3)
    dates = [date(1990, 1, 1) + timedelta(days=9 * i) for i in range(8)]
    asked = spark.createDataFrame([(i, 1, str(d)) for i, d in enumerate([*dates, dates[2]])], "query_no long, k int, since string")
    rows, save = [], graph.save
    monkeypatch.setattr(graph, "save", lambda df: rows.append((out := save(df)).count()) or out)
    got = {(r.query_no, r.tag): r["size"] for r in social.interest_ranges_by_forest(net, asked, task_edges).collect()}
    want = {}
    for i, d in enumerate([*dates, dates[2]]):
        fans = {}
        for p, t in interest:
            if born[p] and born[p] >= d:
                fans.setdefault(t, []).append(p)
        want |= {(i, t): n for t, n in sizes(knows, fans).items()}
    assert got == want
    if task_edges:  # no rows of dates and persons
        assert sum(rows) <= len(interest) + len(knows) * 5 + 9
