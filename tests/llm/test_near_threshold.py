"""Families of long texts just below the threshold: the signatures cannot tell, the second search must, without all pairs."""

import random

import numpy as np
import pytest
from test_operators import brute_components

from kinfolk.llm import jaccard
from kinfolk.llm.common import Frames


def families(copies, between):
    """Texts of two families; members of one are near copies, members of two share a little under four fifths, but for `between` texts that link with both."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    # replacing a stretch of k words takes k + 4 shingles from each side: a little under 0.8 = (2996 - x) / (2996 + x)
    other = words[:1200] + [f"o{i}" for i in range(330)] + words[1530:]
    middle = words[:1200] + [f"o{i}" for i in range(165)] + words[1365:]
    texts = []
    for base in (words, other):
        for i in range(copies):
            t = list(base)
            t[2000 + i] = f"x{i}"
            texts.append(" ".join(t))
    return texts + [" ".join(middle)] * between


@pytest.mark.parametrize("between", [0, 1])
def test_components_of_two_families(spark, between):
    texts = families(9, between)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got == brute_components(dict(enumerate(texts)))
    assert len({c for _, c in got.values()}) == 2 - between


def test_no_more_pairs_than_sets():
    sets = jaccard.shingle_sets(families(20, 0), 5)
    sizes, family = np.array([len(s) for s in sets]), np.arange(len(sets))
    scratch = np.zeros(jaccard.MAX_BITS, np.uint8)
    rough = jaccard.group_pairs(family, sizes, [jaccard.signature(s) for s in sets], (family,), 80, scratch)
    exact = jaccard.group_pairs(family, sizes, sets, (family,), 80, None)
    assert len(exact) == len(sets) - 2 and len(rough) <= len(sets) - 1
    assert all((a < 20) == (b < 20) for a, b in exact)
    apart = np.repeat([0, 1], 20)
    assert jaccard.group_pairs(apart, sizes, sets, (apart,), 80, None) == []


def test_the_second_search_runs(spark, monkeypatch):
    calls, plain = [], jaccard.tree_pairs

    def counted(*args):
        out = plain(*args).cache()
        calls.append((len(args) > 5, out.count()))
        return out

    monkeypatch.setattr(jaccard, "tree_pairs", counted)
    texts = families(9, 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with Frames(spark) as frames:
        # a hub for each family at most: the groups see both families
        rows = jaccard.classified(docs, 5, 80, frames).select("component").distinct().count()
    assert rows == 2 and [second for second, _ in calls] == [False, True]
    assert all(pairs <= len(texts) for _, pairs in calls)
