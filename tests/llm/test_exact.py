"""Exact duplicates against plain Python, over batches, and the plan of the index."""

import hashlib
import re
from collections import Counter, defaultdict

from conftest import SMALL

from kinfolk.llm import exact, queries

ROWS = [
    (5, "a b\tc"), (1, "abc"), (2, " a  b c\n"), (9, " a  b c\n"), (3, None), (4, ""), (6, " \x0b\x0c\r"), (7, "abd"), (8, "a b c"), (11, "é" * 50_000 + " x"), (12, "é" * 50_000 + "x "),
    (None, "abc"), (None, "only without an id"), (7, "abd"),
]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = Counter()
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out[(i, min(groups[norm])[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out, {k: min(v) for k, v in groups.items()}


def frame(spark, rows, more=""):
    return spark.createDataFrame([(*r, *([0] * bool(more))) for r in rows], "doc_id bigint, text string" + more)


def test_decisions_with_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    got = exact.deduplicated(frame(spark, ROWS, ", digest int"), f"file://{tmp_path}/i").collect()
    want, groups = expected(ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_group_with_most_rows(spark, tmp_path):
    rows = [(i, "the same") for i in range(900)] + [(i, f"text {i // 2}") for i in range(900, 3600)]
    got = exact.deduplicated(frame(spark, rows), f"file://{tmp_path}/i").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)[0]
    assert sum(r.kept for r in got) == 1 + 1350


def test_no_rows(spark, tmp_path):
    assert exact.deduplicated(frame(spark, []), f"file://{tmp_path}/i").collect() == []


def test_later_batches_are_held_against_the_index(spark, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/i", buckets=3)
    first = index.add(frame(spark, [(10, "one"), (11, "two"), (12, "t w o")]), "first").collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in first} == {10: (10, True), 11: (12, False), 12: (12, True)}
    second = frame(spark, [(1, "o n e"), (2, "three"), (3, "th ree"), (4, "four")])
    want = {1: (10, False), 2: (3, False), 3: (3, True), 4: (4, True)}
    for _ in range(2):  # a batch may come again, after a failure for one
        reopened = exact.DigestIndex(spark, f"file://{tmp_path}/i", buckets=99)
        assert reopened.buckets == 3
        assert {r.doc_id: (r.keep_id, r.kept) for r in reopened.add(second, "second").collect()} == want
        assert reopened.table().count() == 4
    small = reopened.compact()
    assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, index.table().collect()))


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.add(frame(spark, ROWS), "first")
    plan = index.unseen(spark.createDataFrame([("x",)], "digest string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the batch


def test_query_equals_sql(spark, duck):
    got = sorted(map(tuple, queries.QUERIES["op11_exact_dedup"](spark, SMALL).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    want = sorted(duck.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op11_exact_dedup']})").fetchall())
    assert got == want and len(got) > 100
