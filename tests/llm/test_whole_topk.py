"""Reading sorted lists finds what scoring everything finds, and leaves most pairs unscored once good scores are known."""

import numpy as np

from kinfolk.llm import topk


def brute(ids, rows, k=5, step=50):
    out = []
    for i in np.flatnonzero(ids % step == 0):
        scores = [int(sum(int(a) * int(b) for a, b in zip(rows[i], r, strict=True))) for r in rows]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-scores[j], ids[j]))
        out += [(int(ids[i]), n + 1, int(ids[j]), scores[j]) for n, j in enumerate(order[:k])]
    return sorted(out)


def test_repeated_ids_ties_and_other_lengths(spark):
    rng = np.random.default_rng(8)
    rows = rng.integers(-3, 4, (400, 6))
    ids = np.array([i // 2 if i < 300 else i for i in range(400)])
    table = [(int(i), [float(x) / 256 for x in r]) for i, r in zip(ids, rows, strict=True)] + [(7, [1.0, 2.0]), (8, None), (9, [None] * 6), (10, [float("nan")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*t, 1) for t in table], "vec_id long, embedding array<double>, rank int").repartition(3)
    for block in (64, 2048):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, frame.where("vec_id % 50 = 0"), block=block).collect())
        # queries that share an id are answered together, by rank
        want = {}
        for i in np.flatnonzero(ids % 50 == 0):
            for j in np.flatnonzero(ids != ids[i]):
                want.setdefault(int(ids[i]), []).append((-int(rows[i] @ rows[j]), int(ids[j])))
        assert got == sorted((q, n + 1, j, -x) for q, found in want.items() for n, (x, j) in enumerate(sorted(found)[:5]))


def test_scores_beyond_doubles_are_whole(spark):
    ids, rows = np.arange(60), np.random.default_rng(3).integers(-(2**31), 2**31, (60, 2))
    rows[:, 1] //= 2**20
    frame = spark.createDataFrame([(int(i), [float(x) / 256 for x in r]) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, frame.where("vec_id % 50 = 0"), block=16).collect())
    assert got == brute(ids, rows)


def test_bounds_put_most_candidates_out():
    rng = np.random.default_rng(1)
    ids, rows = np.arange(8192), np.floor(256 * rng.normal(0, 0.1, (8192, 32))).astype(np.int64)
    reader = topk.Reader(ids[:100], rows[:100], 5)
    for a in range(0, len(ids), 1024):
        reader.read(topk.Block(ids[a : a + 1024], rows[a : a + 1024].astype(float)))
    assert reader.resolved < 0.6 * reader.met
    scores = rows[:100] @ rows.T
    for q in range(100):
        order = [j for j in np.lexsort((ids, ~scores[q])) if j != q][:5]
        assert reader.found[q].tolist() == order and reader.scores[q].tolist() == scores[q, order].tolist()
