"""Terms by their numbers, and the work and neighbours of queries whose bounds do not prune."""

import pickle
from collections import Counter

import numpy as np

from kinfolk.llm import toxicity


def test_known_terms_are_the_terms():
    texts = ["", "a b a", "“Größe” – d’été naïve x²y 3rd_word", "Kelvin ΟΔΟΣ Σ İstanbul", "é́tude ٣عدد語 中文。中文", "a\ud800b \udfffc", "x\x00y\x85z　w﻿v", "straße-straße STRASSE 1é2é"]
    words = sorted({w for text in texts for w in toxicity.terms(text) if w.isprintable()} - {"y", "étude"})
    number = toxicity.numbered(words)
    for text in texts:
        want = Counter(words.index(w) for w in toxicity.terms(text) if w in number or w in words)
        got = Counter(toxicity.known(text, number))
        got.pop(None, None)
        assert got == want


def test_flat_bounds_cost_no_picking_of_blocks(monkeypatch):
    """Words strewn over all blocks: bounds leave most blocks, and the lists are read whole rather than block by block; neighbours are those of brute force."""
    rng = np.random.default_rng(4)
    n, n_words, each = 128 * toxicity.BLOCK - 7, 3000, 30
    dense = np.zeros((n, n_words))
    for row in dense:
        row[rng.choice(n_words, each, replace=False)] = rng.integers(1, 4, each)
    dense[1000:1020] = dense[999]  # equal examples
    weight, ids = rng.uniform(0.5, 2, n_words), rng.permutation(n) + 5
    owner, term = np.nonzero(dense)
    index = toxicity.Index.of([f"w{i}" for i in range(n_words)], weight, ids, np.arange(n) % 2, owner, term, dense[owner, term])
    queries = [dict.fromkeys(rng.choice(n_words, 100, replace=False).tolist(), 1) for _ in range(12)]
    queries.append({int(t): int(dense[999, t]) for t in np.flatnonzero(dense[999])})
    x = np.where(dense > 0, (1 + np.log(np.maximum(dense, 1))) * weight, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    picked, spans = [], toxicity.spans
    monkeypatch.setattr(toxicity, "spans", lambda starts, lengths: picked.append(len(starts)) or spans(starts, lengths))
    got = index.nearest(queries, 15)
    assert sum(picked) <= sum(len(q) for q in queries) * (toxicity.AT_ONCE + 3)
    for query, (at, cosines) in zip(queries, got, strict=True):
        q = np.zeros(n_words)
        for t, tf in query.items():
            q[t] = (1 + np.log(tf)) * weight[t]
        want = np.round(x @ (q / np.linalg.norm(q)), 12)
        best = np.lexsort((ids, -want))[:15]
        assert index.doc_ids[at].tolist() == ids[best].tolist() and np.allclose(cosines, want[best], atol=1e-11)


def test_terms_of_many_texts_looked_up_at_once(monkeypatch):
    """Also with many words to a range of hashes, and after a journey."""
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("abcdeéß中"), rng.integers(1, 6))) for _ in range(3000)})
    texts = [" ".join(rng.choice([*words, "zz", "É1ß", "Ab"], rng.integers(0, 80))) for _ in range(60)] + ["", "zz"]
    number = pickle.loads(pickle.dumps(toxicity.numbered(words[::2])))
    want = [Counter(w for w in toxicity.terms(text) if w in set(words[::2])) for text in texts]
    for leading in (toxicity.LEADING, np.uint64(61)):
        monkeypatch.setattr(toxicity, "LEADING", leading)
        number = pickle.loads(pickle.dumps(number))
        owner, term, tf = toxicity.counted(texts, number)
        got = [Counter() for _ in texts]
        for i, t, n in zip(owner, term, tf, strict=True):
            got[i][words[::2][t]] = n
        assert got == want and (np.diff(owner * len(number) + term) > 0).all()
    assert [x.size for x in toxicity.counted(texts, toxicity.numbered([]))] == [0, 0, 0]


def test_flat_bounds_cost_little_more_than_the_lists(monkeypatch):
    """Where bounds leave most blocks, what was read before that is known is a small part of the lists."""
    rng = np.random.default_rng(9)
    n, n_words, each = 128 * toxicity.BLOCK, 3000, 30
    owner, term = np.repeat(np.arange(n), each), np.concatenate([rng.choice(n_words, each, replace=False) for _ in range(n)])
    index = toxicity.Index.of([f"w{i}" for i in range(n_words)], rng.uniform(0.5, 2, n_words), np.arange(n), np.arange(n) % 2, owner, term, np.ones(len(term)))
    queries = [dict.fromkeys(rng.choice(n_words, 100, replace=False).tolist(), 1) for _ in range(12)]
    read, sums = [], index._sums
    monkeypatch.setattr(index, "_sums", lambda lo, n, *rest: read.append(int(n.sum())) or sums(lo, n, *rest))
    index.nearest(queries, 15)
    held = np.bincount(term, minlength=n_words)
    assert sum(read) <= 1.1 * sum(held[t] for q in queries for t in q)
