"""Copies of rows with null and repeated ids, and their places in the training order."""

from collections import Counter

from conftest import SMALL

from kinfolk.llm import mixing, queries
from kinfolk.llm.common import documents


def test_curriculum_has_rows_of_null_and_repeated_ids_as_often_as_taken(spark):
    rows = [(None, "a b c", "x"), (None, "d e", "x"), (7, "f g h i", "x"), (7, "j", "x"), (7, "j", "y"), (8, "k l", None), (None, None, "x"), (9, " ", "y"), *((i, f"w{i} v", "x") for i in range(20, 40))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = Counter()
    for r in mixing.mix(table).collect():
        taken[r.doc_id, r.source, r.size] += r.repeats
    copies = mixing.curriculum(table)
    got = copies.collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == +taken
    assert any(r.doc_id is None for r in got) and copies.columns == [*table.columns, "train_position"]
    assert [r.train_position for r in got] == sorted(r.train_position for r in got)
    assert got == mixing.curriculum(table.repartition(5)).collect()


def test_op9_places_are_the_training_order(spark):
    """Every copy of every document stands in the result, at its number in the order of `curriculum`; the named columns are those of `mix`."""
    table = documents(spark, SMALL)
    got = queries.op9_source_mixing(spark, SMALL).collect()
    copies = [(place, position, r.doc_id) for r in got for place, position in zip(r.places, r.positions, strict=True)]
    assert [c[0] for c in sorted(copies)] == list(range(len(copies)))
    assert [c[1:] for c in sorted(copies)] == [(r.train_position, r.doc_id) for r in mixing.curriculum(table).collect()]
    assert all(len(r.places) * r.size == r.taken and r.position == (r.positions[0] if r.positions else None) for r in got)
    named = ("doc_id", "size", "source_size", "target", "taken")
    assert sorted(tuple(r[c] for c in named) for r in got) == sorted(map(tuple, mixing.mix(table).select(*named).collect()))


def test_schedule_of_null_and_repeated_ids_inverts_by_hand(spark):
    """Places by an own sort of positions that are found by bisection of the integral; null and repeated ids keep their rows."""
    rows = [(None, "a b c", "x"), (None, "d e", "x"), (7, "f g h i", "x"), (7, "j", "y"), (8, "k l", None), (None, None, "x"), (9, " ", "y"), *((i, f"w{i} v", "xyz"[i % 3]) for i in range(20, 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.schedule(table).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    found = []
    for r in got:
        for copy in range(r.repeats):
            share, low, high = (r.before + copy * r.source_size) / r.target, 0.0, 1.0
            for _ in range(60):
                t = (low + high) / 2
                low, high = (t, high) if t * 2 / (1 + r.slope) + t * t * (r.slope - 1) / (1 + r.slope) < share else (low, t)
            assert abs(r.positions[copy] - low) < 1e-6
            found.append((r.places[copy], low))
    assert [f[0] for f in sorted(found)] == list(range(len(found))) and all(a[1] <= b[1] + 1e-6 for a, b in zip(sorted(found), sorted(found)[1:], strict=False))
    key = lambda rows: sorted((str(r.doc_id), r.size, r.places) for r in rows)
    assert key(got) == key(mixing.schedule(table.repartition(5)).collect())
    assert mixing.schedule(table.where("false")).collect() == []
