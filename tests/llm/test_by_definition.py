"""Models and fingerprints against their definitions."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk.llm import chroma, mixing, quality


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine()
    model.w0, model.w = 0.3, rng.normal(size=len(model.w))
    texts = ["", "one two three", "One one TWO 2 ; = {", "zwei drei\nvier vier vier. " * 3]
    rows, columns, x = model.cells(*quality.features(texts))
    got, _ = model.logits(len(texts), rows, columns, x)
    for i in range(len(texts)):
        mine = [(c, v) for r, c, v in zip(rows, columns, x, strict=True) if r == i]
        want = model.w0 + sum(model.w[c] * v for c, v in mine)
        want += sum(float(model.v[a] @ model.v[b]) * p * q for k, (a, p) in enumerate(mine) for b, q in mine[:k])
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_repeated_labels_and_texts_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else "x y z ; ; ;", "s") for i in range(60)] + [(None, "good", "s")], "doc_id long, text string, score string")
    marked = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, marked)).collect()}
    assert len(got) == 61 and got[None].held_out
    assert min(got[i].score for i in range(1, 60, 2)) > max(got[i].score for i in range(0, 60, 2))


def aligned(prints, queries, least_votes=4, most_errors=0.3):
    """Of each query and recording the best offset by votes (ties: nearest to 0, then smaller), if it has votes enough and few wrong bits."""
    out = set()
    for q, a in queries:
        for r, own in prints:
            if q is None or r is None or q == r:
                continue
            places = defaultdict(list)
            for i, x in enumerate(a):
                places[x].append(i)
            votes = Counter(i - j for j, x in enumerate(own) for i in places[x])
            votes = {d: v for d, v in votes.items() if v >= least_votes}
            if not votes:
                continue
            d = min(votes, key=lambda d: (-votes[d], abs(d), d))
            over = [j for j in range(len(own)) if 0 <= j + d < len(a)]
            errors = sum(int(own[j] ^ a[j + d]).bit_count() for j in over) / (32 * len(over))
            if errors <= most_errors:
                out.add((q, r, d, votes[d], round(errors, 9)))
    return out


def test_alignments_by_definition(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, 40, dtype=np.uint32)
    noisy = base ^ (np.uint32(1) << rng.integers(0, 32, 40).astype(np.uint32)) * (rng.random(40) < 0.4).astype(np.uint32)
    sounds = {0: base, 1: base[7:], 2: noisy, 3: rng.integers(0, 2**32, 30, dtype=np.uint32), 4: np.concatenate([rng.integers(0, 2**32, 9, dtype=np.uint32), base[:20]]), 5: base[:0], 6: np.repeat(base[:1], 25), 7: np.repeat(base[:1], 12), 8: base}
    rows = [(i, s.astype("<u4").tobytes(), 1) for i, s in sounds.items()] + [(None, base.tobytes(), 1), (9, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, fingerprint binary, votes int").repartition(3)
    asked = table.where("vec_id % 2 = 0")
    got = {(r.query_id, r.vec_id, r.shift, r.votes, round(r.bit_error, 9)) for r in chroma.align(table, asked).collect()}
    pairs = [(i, s.tolist()) for i, s in sounds.items()]
    assert got == aligned(pairs, [p for p in pairs if p[0] % 2 == 0])
    assert {(0, 1), (0, 2), (0, 4), (0, 8), (6, 7)} <= {(q, r) for q, r, *_ in got}
    assert chroma.align(table, asked.where("false")).collect() == [] and chroma.align(table.where("false"), asked).collect() == []


def test_recall_under_noise(spark):
    """Tunes with noise at a tenth of their loudness, cut at the start, still find their originals."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(12):
        notes = 220 * 2 ** (rng.integers(-20, 20, 90) / 12)
        clean = 8000 * np.sin(2 * np.pi * notes[:, None] * np.arange(chroma.HOP) / chroma.RATE).ravel()
        rows.append((2 * i, clean.astype("<i2").tobytes()))
        rows.append((2 * i + 1, (clean + rng.normal(0, 800, len(clean)))[10 * chroma.HOP :].astype("<i2").tobytes()))
    prints = chroma.fingerprints(spark.createDataFrame(rows, "vec_id long, pcm binary").repartition(3)).cache()
    got = {(r.query_id, r.vec_id) for r in chroma.align(prints, prints.where("vec_id % 2 = 0")).collect()}
    found = sum((2 * i, 2 * i + 1) in got for i in range(12))
    assert found >= 11
    assert all(abs(a - b) == 1 and min(a, b) % 2 == 0 for a, b in got)


def test_positions_invert_the_integral(spark):
    """Integrated up to a copy's position, a source's linear weight has delivered the words before the copy."""
    asked = [(done / 20, slope) for done in range(21) for slope in (1 / 3, 0.5, 1.0, 3.0, 9.0)]
    rows = spark.createDataFrame(asked, "done double, slope double").select("done", "slope", mixing.position(F.col("done") * 700, F.lit(700.0), F.col("slope")).alias("t"))
    for r in rows.collect():
        first, last = 2 / (1 + r.slope), 2 * r.slope / (1 + r.slope)
        assert r.t * first + r.t * r.t / 2 * (last - first) == pytest.approx(r.done, abs=1e-9) and 0 <= r.t <= 1 + 1e-12
