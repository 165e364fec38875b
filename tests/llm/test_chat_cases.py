"""Preference formatting: large ids, ties, repeated and empty turns, nothing at all."""

from kinfolk.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, pair_id string"


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r.pair_id: r for r in chat.preferences(chat.conversation_pairs(spark, str(tmp_path))).collect()}


def test_ids_beyond_doubles(spark, tmp_path):
    ids = [2**53 + 2, 2**53 + 3, 2**53 + 4, 2**53 + 5, 2**62, 2**62 + 1]
    got = table(spark, tmp_path, [(i, t, "user", f"{t}" if t < 2 else f"{i}", "clash") for i in ids for t in range(3)])
    assert sorted(got) == [2**52 + 1, 2**52 + 2, 2**61]
    assert all((r.n_prompt, r.n_chosen, r.n_rejected) == (2, 1, 1) for r in got.values())
    assert got[2**61].chosen == f"<|user|>\n{2**62}<|end|>\n" and got[2**61].rejected == f"<|user|>\n{2**62 + 1}<|end|>\n"


def test_equal_turns_repeats_nulls_and_long_texts(spark, tmp_path):
    long = "x" * 300_000
    rows = [(0, 1, "user", "b", ""), (0, 1, "user", "a", ""), (0, 1, "user", "a", ""), (0, None, None, None, ""), (0, 2, "assistant", long, ""), (1, 1, "user", "a", ""), (1, 1, "user", "b", ""), (1, 1, "user", "a", ""), (1, None, "", "", ""), (None, 1, "user", "gone", "")]
    got = table(spark, tmp_path, rows)
    assert list(got) == [0]
    r = got[0]
    assert (r.n_prompt, r.n_chosen, r.n_rejected) == (4, 1, 0)
    assert r.prompt == "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in (("", ""), ("user", "a"), ("user", "a"), ("user", "b")))
    start, end = map(int, r.chosen_spans.split(":"))
    assert r.chosen[start:end] == long + "<|end|>\n" and r.rejected == r.rejected_spans == ""


def test_negative_ids_and_one_side(spark, tmp_path):
    got = table(spark, tmp_path, [(-2, 0, "user", "c", ""), (-1, 0, "user", "r", ""), (7, 0, "assistant", "only", "")])
    assert (got[-1].chosen, got[-1].rejected) == ("<|user|>\nc<|end|>\n", "<|user|>\nr<|end|>\n")
    assert (got[3].n_prompt, got[3].n_chosen, got[3].n_rejected) == (0, 0, 1)


def test_nothing(spark, tmp_path):
    assert table(spark, tmp_path, []) == {}
