"""Preference pairs: one prompt and two masked completions.

A pair has a chosen and a rejected conversation. The turns both begin with are rendered
once, as the prompt; what is left of either is its completion. A mask lists the stretches
of the completion to train on: what the assistant says, with its end mark.

A conversation becomes one row, so it is gathered where that row is made; a pair of
conversations must fit in a row, as its result must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template. Marks in a text are left as they are; the masks count characters.
HEAD, HEAD_END, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def turns(rows: DataFrame, name: str) -> DataFrame:
    """``(pair_id, name)``: the distinct turns of each conversation in order."""
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_set(turn)).alias(name))


def shared(chosen: Column, rejected: Column) -> Column:
    """Number of turns both begin with: role and text alike."""
    upto = F.least(F.size(chosen), F.size(rejected))
    differs = F.filter(
        F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (chosen[i]["role"] != rejected[i]["role"]) | (chosen[i]["text"] != rejected[i]["text"]))
    return F.coalesce(F.try_element_at(differs, F.lit(1)), upto)


def rendered(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(HEAD_END), t["text"], F.lit(END))), "")


def mask(part: Column) -> Column:
    """Stretches to train on, as ``start:length`` in characters, joined by commas."""
    ahead, behind = len(HEAD) + len(HEAD_END), len(END)
    spans = F.aggregate(
        part, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + ahead + F.char_length(t["role"]) + F.char_length(t["text"]) + behind).alias("at"),
            F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(F.concat(
                (acc["at"] + ahead + F.char_length(t["role"])).cast("string"), F.lit(":"), (F.char_length(t["text"]) + behind).cast("string")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return F.array_join(spans, ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask)`` for each pair id.

    Both sides are ``(pair_id, turn, role, text)``. Turns go by ``turn``, then role and text; a
    turn that repeats another in all of these counts once. A null turn comes first; null role
    and text are empty; null pair ids are one pair. A pair with one side only has the other
    empty, so nothing in common. Other columns are ignored; empty tables give no rows.
    """
    a, b = turns(chosen, "_a"), turns(rejected, "_b")
    none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    both = a.join(b.withColumnRenamed("pair_id", "_id"), F.col("pair_id").eqNullSafe(F.col("_id")), "full").select(
        F.coalesce("pair_id", "_id").alias("pair_id"), none("_a", a).alias("_a"), none("_b", b).alias("_b"))
    cut = both.withColumn("n_common", shared(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    cut = cut.select("pair_id", "n_common", F.slice("_a", F.lit(1), F.col("n_common")).alias("_p"), rest("_a").alias("_a"), rest("_b").alias("_b"))
    return cut.select(
        "pair_id", "n_common", rendered(F.col("_p")).alias("prompt"), rendered(F.col("_a")).alias("chosen"), rendered(F.col("_b")).alias("rejected"),
        mask(F.col("_a")).alias("chosen_mask"), mask(F.col("_b")).alias("rejected_mask"))


def contrasted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides of a table ``(conv_id, turn, role, text)`` without judgements.

    Chosen is a conversation up to its last assistant turn; rejected ends in the last answer
    of the neighbouring conversation (ids 2k and 2k + 1) instead, or in an empty one. A
    conversation without an answer is on both sides whole.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    said = F.col("role") == TRAINED
    answers = rows.filter(said).groupBy("pair_id").agg(F.max("turn").alias("_last"), F.max_by("text", F.struct("turn", "text")).alias("_answer"))
    met = rows.join(answers.select("pair_id", "_last"), "pair_id", "left")
    upto = F.col("_last").isNull() | (F.col("turn") <= F.col("_last"))
    cut = (F.col("turn") == F.col("_last")) & said
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("_answer").alias("_other"))
    swapped = answers.join(other, "pair_id", "left").select(
        "pair_id", F.col("_last").alias("turn"), F.lit(TRAINED).alias("role"), F.coalesce("_other", F.lit("")).alias("text"))
    columns = ("pair_id", "turn", "role", "text")
    return met.filter(upto).select(*columns), met.filter(upto & ~F.coalesce(cut, F.lit(False))).select(*columns).unionByName(swapped)
