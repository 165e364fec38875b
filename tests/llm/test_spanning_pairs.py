"""Spanning pairs of a group connect all families that link, by brute force over the sets."""

import numpy as np
import pytest

from kinfolk.llm import jaccard


def joined(family, pairs):
    """The families after joining by the pairs, and how many pairs joined two that were apart."""
    root, useful = family.copy(), 0
    for a, b in pairs:
        if root[a] != root[b]:
            root[root == root[b]] = root[a]
            useful += 1
    return {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}, useful


@pytest.mark.parametrize("alone", [True, False])
def test_spanning_pairs_connect_all_families_that_link(alone):
    rng, sets = np.random.default_rng(2), []
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(10, 300)).astype(np.uint64))
        sets += [base, np.unique(np.concatenate([base[1:], base[:1] + np.uint64(1)])), np.unique(np.concatenate([base[len(base) // 2 :], base[:1]]))]
        sets += [base[len(base) // 20 :], base[: -len(base) // 6]]
    sizes = np.array([len(s) for s in sets])
    family = np.arange(len(sets)) // (1 if alone else 2)
    linked = []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if family[a] != family[b] and 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                linked.append((a, b))
    want, least = joined(family, linked)
    exact = jaccard.group_pairs(family, sizes, sets, (family,), 80, None)
    assert joined(family, exact) == (want, len(exact)) and least == len(exact) > 20
    assert {tuple(sorted(p)) for p in exact} <= set(linked)
    scratch = np.zeros(jaccard.MAX_BITS, np.uint8)
    rough = jaccard.group_pairs(family, sizes, [jaccard.signature(s) for s in sets], (family,), 80, scratch)
    assert not scratch.any() and joined(family, rough)[1] == len(rough)
    assert joined(family, rough + linked)[0] == joined(family, rough)[0]  # may join more, not less
