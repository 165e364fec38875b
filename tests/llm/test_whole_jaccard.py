"""Near copies give few pairs; blocks, mixed sizes and repeated ids lose none."""

import numpy as np
import pytest

from kinfolk.llm import jaccard
from test_operators import brute_components, shingles


def variants(m, words=200, base="w"):
    out = []
    for k in range(m):
        text = [f"{base}{i}" for i in range(words)]
        text[(7 * k) % words] = f"edit{base}{k}"
        out.append(" ".join(text))
    return out


def found(spark, texts):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("block", [1024, 16])
def test_variants_with_one_word_edited_give_few_pairs(spark, monkeypatch, block):
    made, tree_pairs = [], jaccard.tree_pairs

    def counted(*args):
        made.append(jaccard.Frames(spark).save(tree_pairs(*args)))
        return made[-1]

    monkeypatch.setattr(jaccard, "tree_pairs", counted)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = dict(enumerate(variants(120) + variants(3, base="v")))
    assert found(spark, texts) == brute_components(texts)
    assert sum(m.count() for m in made) <= len(texts)


def test_copies_just_below_and_above_the_threshold_in_one_group(spark):
    # the more words are edited, the farther from the base; the base is not there
    texts, rng = {}, np.random.default_rng(4)
    for k in range(60):
        text = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, 1 + k % 6, replace=False):
            text[at] = f"e{k}x{at}"
        texts[k] = " ".join(text)
    assert found(spark, texts) == brute_components(texts)


def test_short_and_long_texts_that_share_a_passage(spark):
    passage, rng = [f"p{i}" for i in range(60)], np.random.default_rng(6)
    texts = {k: " ".join(passage[: 5 + k % 56] + [f"own{k}x{i}" for i in range(rng.integers(0, 12) if k % 2 else 3000 * (k % 10 == 0))]) for k in range(80)}
    assert found(spark, texts) == brute_components(texts)


def test_repeated_and_null_ids_are_judged_by_their_own_texts(spark):
    a, b, near = variants(3)
    other = "so it goes on and on until the very last of all words"
    rows = [(1, a), (5, a), (5, other), (7, b), (9, other + " x"), (5, other), (None, near), (None, "alone in all the world it stands"), (3, ""), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    texts = dict(enumerate(t or "" for _, t in rows))
    want = []
    least = {}
    for i, (_, c) in brute_components(texts).items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    for i, (n, c) in brute_components(texts).items():
        want.append((rows[i][0], n, least.get(c)))
    assert got == sorted(want, key=str)


def test_keep_one_keeps_a_row_of_each_component(spark):
    a, b, _ = variants(3)
    rows = [(5, a, 1), (5, a, 1), (7, b, 2), (5, "so it goes on and on until the end", 3), (None, "so it goes on and on until the end", 4), (None, "", 5), (None, "", 5), (8, None, 6)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, class long"))
    assert kept.columns == ["doc_id", "text", "class"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], *rows[5:]], key=str)


def test_group_pairs_span_all_families_that_link():
    rng, sets = np.random.default_rng(2), []
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(10, 300)).astype(np.uint64))
        sets += [base, np.unique(np.concatenate([base[1:], base[:1] + np.uint64(1)])), np.unique(np.concatenate([base[len(base) // 2 :], base[:1]]))]
    sizes, places = np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets]
    family = np.arange(len(sets)) // 2
    scratch = np.zeros(jaccard.MAX_BITS, np.uint8)
    every = jaccard.group_pairs(family, sizes, places, (family,), 80, False, scratch)
    some = jaccard.group_pairs(family, sizes, places, (family,), 80, True, scratch)
    assert not scratch.any() and set(some) <= set(every)
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if family[a] != family[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in every or (b, a) in every
    assert len(shingles("a b c d e f")) == 2
