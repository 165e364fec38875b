"""Preference formatting; DataFrame functions only.

Two conversations, one chosen and one rejected, share a longest common prefix of turns (equal role and text, in turn order). It is rendered once as the
prompt; what follows in each is its completion, with the character spans that count for the loss: the texts of assistant turns and their end marks.

Cases: a null role or text is empty; a pair with one side only has an empty other side and no common prefix; equal conversations have empty completions;
turns with equal or null numbers stand in the order of role and text, nulls first, repeated rows beside each other; rows with a null key are left out; an empty table
gives no rows; other columns are ignored. Texts are rendered as they are: one that holds the marks of a turn looks like turns, so whoever trains on untrusted texts
takes the marks out of them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, NAMED, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(NAMED), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained: str) -> Column:
    """start:end of each trained turn's text with its end mark, in characters of the rendered completion."""
    head = len(OPEN) + len(NAMED)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(held: Column, t: Column) -> Column:
        begin = held["at"] + head + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        here = F.when(t["role"] == trained, F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.cast("int").alias("at"), F.concat(held["spans"], here).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preferences(turns: DataFrame, key: str = "pair_id", chosen: str = "is_chosen", trained: str = "assistant") -> DataFrame:
    """One row per pair from its turns (key, chosen, turn, role, text): key, n_prompt, n_chosen, n_rejected (turns), prompt, chosen, rejected, chosen_spans, rejected_spans."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.where(F.col(key).isNotNull() & F.col(chosen).isNotNull()).groupBy(F.col(key).alias("pair_id"))
    pairs = sides.agg(*(F.sort_array(F.collect_list(F.when(F.col(chosen) == side, turn))).alias(name) for name, side in (("a", True), ("b", False))))
    unequal = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(unequal, False)
    n = F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int")
    split = pairs.withColumn("n", n).select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), *(F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))).alias(x) for x in ("a", "b")))
    return split.select(
        "pair_id", F.col("n").alias("n_prompt"), F.size("a").alias("n_chosen"), F.size("b").alias("n_rejected"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"), _spans(F.col("a"), trained).alias("chosen_spans"), _spans(F.col("b"), trained).alias("rejected_spans"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of `conversations` as pairs: of each two neighbouring conv_ids the even one is chosen, the odd one rejected."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text")
