"""Every alignment of each query."""

import duckdb
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from kinfolk.llm import chroma, queries


def test_op10_returns_every_alignment(spark):
    prints = chroma.fingerprints(chroma.sonified(spark, SMALL))
    asked = prints.where("vec_id % 100 = 0")
    want = [tuple(r) for r in chroma.align(prints, asked).collect()]
    alone = {r.vec_id for r in asked.collect()} - {w[0] for w in want}
    got = queries.op10_chroma_fingerprints(spark, SMALL)
    assert got.columns == ["query_id", "vec_id", "shift", "votes", "bit_error"]
    assert sorted(map(tuple, got.where(F.col("vec_id").isNotNull()).collect())) == sorted(want)
    assert {r.query_id for r in got.where("vec_id is null").collect()} == alone


ALIGNED = """
WITH votes AS (SELECT q.id AS query_id, r.id AS vec_id, q.k - r.k AS shift, count(*) AS votes FROM t q JOIN t r ON q.v = r.v AND q.id % 100 = 0 AND q.id <> r.id GROUP BY ALL HAVING count(*) >= 4),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY votes DESC, abs(shift), shift) = 1)
SELECT b.query_id, b.vec_id, b.shift, b.votes, sum(bit_count(xor(q.v, r.v))) / (32.0 * count(*)) AS bit_error
FROM best b JOIN t q ON q.id = b.query_id JOIN t r ON r.id = b.vec_id AND q.k - r.k = b.shift GROUP BY ALL HAVING bit_error <= 0.3"""


def test_op10_returns_every_alignment_of_large_families(spark, tmp_path):
    """A family of m like vectors, one in five of them a query, has as many rows as SQL finds alignments in it, of the order of m^2, and so have copies."""
    rng, rows = np.random.default_rng(5), []
    for f, (members, noise) in enumerate([(40, 0.05), (80, 0.05), (30, 0.0)]):
        base = rng.normal(0, 0.125, 64)
        rows += [(10_000 * f + 20 * i, (base + noise * rng.normal(0, 0.125, 64)).tolist(), 1) for i in range(members)]
    rows += [(50_000 + i, rng.normal(0, 0.125, 64).tolist(), 1) for i in range(101)]
    rows += [(60_000, None, 1), (60_100, [], 1), (None, rows[0][1], 1), (60_200, [float("nan"), None] * 32, 1), (60_201, [0.0] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    prints = chroma.fingerprints(chroma.sonified(spark, str(tmp_path))).where("vec_id is not null").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, k BIGINT, v UINTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(r.vec_id, k, v) for r in prints for k, v in enumerate(np.frombuffer(bytes(r.fingerprint), "<u4").tolist())])
    want = {(*r[:4], round(r[4], 9)) for r in con.execute(ALIGNED).fetchall()}
    got = queries.op10_chroma_fingerprints(spark, str(tmp_path)).collect()
    found = [(r.query_id, r.vec_id, r["shift"], r.votes, round(r.bit_error, 9)) for r in got if r.vec_id is not None]
    assert len(found) == len(set(found)) and set(found) == want
    assert sorted(r.query_id for r in got if r.vec_id is None) == sorted({i for i, *_ in rows if i is not None and i % 100 == 0} - {w[0] for w in want})
    of = [sum(10_000 * f <= w[0] < 10_000 * (f + 1) for w in want) for f in range(3)]
    assert of[0] > 40 and of[1] > 2.5 * of[0] and of[2] == 6 * 29
