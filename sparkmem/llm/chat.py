"""Operator 4, chat formatting: preference pairs with a shared prompt (DataFrame functions only).

For each pair the longest common prefix of turns (role and text equal, by position) of the chosen and
the rejected conversation is rendered once, as the prompt; what follows in each is its completion, with
the character spans on which a loss is taken (the contents and end marks of assistant turns; everything else is masked).
The common prefix comes from one join of turns by (pair, position) and a minimum of the first
difference; completions and prompts are collected per pair, which is the size of the output row.

Nulls and odd input: a null role is rendered ``unknown`` and a null text as empty, and both count as equal to
themselves; turns of equal number are taken in the order of role and text; a conversation without partner
gets an empty completion on the other side (``has_rejected`` / ``has_chosen`` false); rows with a null pair id or a null
side are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"     # the public ChatML frame


def _frame(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MID), text, F.lit(END))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair from turns (pair_id, chosen boolean, turn, role, text).

    Columns: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans (arrays of
    (from_char, to_char) within the completion), has_chosen, has_rejected.
    """
    t = (turns.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
         .select("pair_id", "chosen", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")))
    w = Window.partitionBy("pair_id", "chosen").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(w) - 1)
    # a position is common when both sides hold it with one role and text: two rows, one distinct value
    same = (t.groupBy("pair_id", "pos")
            .agg(F.count("*").alias("n"), F.min("role").alias("r0"), F.max("role").alias("r1"),
                 F.min("text").alias("t0"), F.max("text").alias("t1"))
            .select("pair_id", "pos", ((F.col("n") == 2) & (F.col("r0") == F.col("r1"))
                                       & (F.col("t0") == F.col("t1"))).alias("common")))
    cut = same.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("common"), F.col("pos"))), F.max("pos") + 1).cast("int").alias("n_prompt_turns"))
    t = t.join(cut, "pair_id")
    turn_row = F.struct("pos", "role", "text")
    after = F.col("pos") >= F.col("n_prompt_turns")
    sides = t.groupBy("pair_id").agg(
        F.first("n_prompt_turns").alias("n_prompt_turns"),
        F.max(F.col("chosen")).alias("has_chosen"), F.max(~F.col("chosen")).alias("has_rejected"),
        # the prompt's turns are equal on both sides; one side is kept
        F.array_sort(F.collect_set(F.when(~after, turn_row))).alias("p"),
        F.array_sort(F.collect_list(F.when(after & F.col("chosen"), turn_row))).alias("c"),
        F.array_sort(F.collect_list(F.when(after & ~F.col("chosen"), turn_row))).alias("r"))

    def render(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda x: _frame(x["role"], x["text"])), "")

    def spans(name: str) -> Column:
        """Character spans to train on: after the opening mark of an assistant turn, through its end mark."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from_char:long,to_char:long>>").alias("s"))

        def step(acc, x):
            head = F.length(F.concat(F.lit(START), x["role"], F.lit(MID))).cast("long")
            whole = F.length(_frame(x["role"], x["text"])).cast("long")
            one = F.array(F.struct((acc["at"] + head).alias("from_char"),
                                   (acc["at"] + whole - F.lit(1)).alias("to_char")))
            return F.struct((acc["at"] + whole).alias("at"),
                            F.when(x["role"] == "assistant", F.concat(acc["s"], one)).otherwise(acc["s"]).alias("s"))

        return F.aggregate(F.col(name), zero, step, lambda acc: acc["s"])

    return sides.select("pair_id", "n_prompt_turns", render("p").alias("prompt"),
                        render("c").alias("chosen"), render("r").alias("rejected"),
                        spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"),
                        "has_chosen", "has_rejected")
