"""The plan stays near the linear program's bound; equal rows get places of their own."""

import numpy as np
import public_tokenizers
import pytest

from kinfolk.llm import packing


@pytest.mark.parametrize("kind, gap", [("hot", 0.01), ("uniform", 0.01), ("lognormal", 0.005), ("halves", 0.01)])
def test_plan_is_near_the_bound_of_the_linear_program(kind, gap):
    rng = np.random.default_rng(1)
    if kind == "hot":
        lengths, counts, room = np.array([19, 31, 40, 59, 62, 73]), np.array([3831, 8116, 1436, 1284, 1127, 4451]), 100
    elif kind == "uniform":
        (lengths, counts), room = np.unique(rng.integers(1, 101, 5000), return_counts=True), 100
    elif kind == "halves":
        lengths, counts, room = np.array([51, 52, 53]), np.array([100, 200, 300]), 100
    else:
        (lengths, counts), room = np.unique(np.clip(rng.lognormal(4.5, 0.8, 5000).astype(int), 1, 512), return_counts=True), 512
    plan, bound = packing.plan(lengths, counts, room)
    assert (sum(c * t for c, t in plan) == counts).all() and all((c * lengths).sum() <= room for c, _ in plan)
    used = sum(t for _, t in plan)
    assert bound <= used * (1 + 1e-9) and used <= (1 + gap) * bound + 1
    assert kind != "halves" or used == 600


def test_equal_rows_and_null_ids_get_places_of_their_own(spark):
    rows = [(None, "one and the same text", 1)] * 300 + [(5, "", 2)] * 30 + [(6, None, 3), (6, "word " * 700, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    out = packing.pack(frame, public_tokenizers.path("word_bpe_49k.json"), capacity=512).toPandas()
    assert len(out) == 300 + 30 + 1 + 2
    for _, sequence in out.sort_values("offset").groupby("sequence_id"):
        ends = sequence.offset + sequence.length
        assert sequence.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= 512


def test_texts_of_many_scripts_and_odd_spaces_have_the_tokenizers_ids():
    ids, rng = packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(1)
    assert ids.pattern is not None
    signs = [chr(c) for c in [*range(0x250), *range(0x370, 0x460), *range(0x300, 0x310), 0x2019, 0x2013, 0x2026, 0x4E00, 0xAC00, 0x1F600, 0x1680, 0x2028, 0xFB01]] + ["<|endoftext|>", "'s", "'LL", "don't", "WORD"] * 20
    for _ in range(1500):
        text = "".join(rng.choice(signs, rng.integers(1, 12)))
        joined = b"".join(map(ids.__getitem__, filter(None, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))
        assert joined == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
