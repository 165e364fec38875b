"""Runs against the definition, word by word."""

import hashlib
import random
import zlib

from conftest import SMALL

from kinfolk.llm import periodic, queries


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        t = q
        while t < n:
            first = t
            while t < n and w[t] == w[t - q]:
                t += 1
            if t - first + q >= max(6, 4 * q) and not any(all(w[x] == w[x - r] for x in range(first - q + r, t)) for r in range(1, q)):
                out.append((first - q, t - first + q, q))
            t += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(seed):
    rng = random.Random(seed)
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 6]))}" for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(w) + 1)
        w[at:at] = [f"w{rng.randrange(3)}" for _ in range(rng.randint(1, 7))] * rng.randint(2, 9)
    return w


def test_runs_and_what_is_left(spark):
    texts = [" ".join(words(s)) for s in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in periodic.scan(docs).collect():
        w = texts[r.doc_id].split()
        runs = brute(w)
        assert [tuple(x) for x in r.runs] == runs, texts[r.doc_id]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone) and r.n_words == len(w)


def test_cases(spark):
    long = "x " * 60_000 + " y " + " ".join(f"{i % 700}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \x0b\n", 0), (4, "a a a a a", 0), (5, "a a a a a a", 0), (5, "a a a a a a", 0), (None, "b\tb\rb b\x0cb b b", 0), (6, "A a A a A a A a", 0), (7, long, 0), (8, "x x x x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    got = {}
    for r in periodic.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(5, [], "a a a a a")]
    assert got[5] == [(6, [(0, 6, 1)], "a")] * 2
    assert got[None] == [(7, [(0, 7, 1)], "b")]
    assert got[6] == [(8, [(0, 8, 2)], "A a")]
    assert got[7][0][1] == [(0, 60_000, 1), (60_001, 30_000, 700)]
    assert got[8] == [(2, [], "x x x x")]
    assert periodic.scan(docs.where("false")).collect() == []


def test_digests(spark):
    docs = spark.createDataFrame([(1, "q " + "a b " * 5 + "z z z z z z z"), (2, "nothing here")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic.digest(periodic.scan(docs)).collect()}
    r, s = got[1], got[2]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 1, 10, 2, 5000)
    assert r.runs_sha256 == hashlib.sha256(b"1,10,2\n11,7,1\n").hexdigest()
    assert r.collapsed_sha256 == hashlib.sha256(b"q a b z").hexdigest()
    assert (s.n_runs, s.start, s.length, s.period, s.exponent_milli) == (0, None, None, None, None)
    assert s.runs_sha256 == hashlib.sha256(b"").hexdigest() and s.collapsed_sha256 == hashlib.sha256(b"nothing here").hexdigest()


def test_planted_tails():
    for i in range(300):
        w = [b"%d" % k for k in range(i % 37)]
        h, n = zlib.crc32(str(i).encode()), len(w)
        want = list(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert periodic.planted_tail(i, w) == want
    assert periodic.planted_tail(None, [b"a"]) == [b"a"]


def test_query_equals_sql(spark, duck):
    columns = "doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256"
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, SMALL).select(*columns.split(", ")).collect()))
    want = sorted(duck.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op13_periodic_runs']})").fetchall())
    assert got == want and any(r[1] for r in got)
