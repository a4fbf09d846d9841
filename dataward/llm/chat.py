"""Preference formatting of chosen and rejected conversations.

A pair's conversations are arrays of turns. Their longest common turn prefix is rendered
once, as the prompt; the remaining turns of each side are its completion, with the character
spans that are trained on: what assistants say, with the end mark, never what users say.

Everything is DataFrame expressions; one shuffle brings a conversation's turns together.

Defined results. Repeated rows count once. Turns come by number (null last), then role, then
text. A null role is `unknown`, a null text is empty. Rows without a pair id or side are
ignored, and so are pairs that lack a side or whose sides are equal: they express no
preference. If one side is a prefix of the other, its completion is empty. The opening mark
of the template inside a text is broken by a space, so no text can forge a turn. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _turns() -> Column:
    """The turns of a group in order, as (role, text)."""
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
                    F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.transform(F.sort_array(F.collect_set(turn)),
                       lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def rendered(turn: Column) -> Column:
    safe = [F.replace(turn[c], F.lit(OPEN), F.lit("< |")) for c in ("role", "text")]
    return F.concat(F.lit(OPEN), safe[0], F.lit(CLOSE), safe[1], F.lit(END))


def _completion(turns: Column) -> tuple[Column, Column]:
    """Text of the turns, and the spans [start, end) of it that are trained on."""
    text = F.array_join(F.transform(turns, rendered), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        whole = F.length(rendered(turn))
        start = state["at"] + F.length(F.replace(turn["role"], F.lit(OPEN), F.lit("< |"))) + len(OPEN) + len(CLOSE)
        span = F.struct(start.cast("int").alias("start"), (state["at"] + whole).cast("int").alias("end"))
        return F.struct((state["at"] + whole).cast("int").alias("at"),
                        F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    return text, F.aggregate(turns, none, add)["spans"]


def formatted(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen, rejected), each side an array of (role, text): adds the prompt,
    both completions and their masks."""
    both = F.least(F.size("chosen"), F.size("rejected"))
    # position of the first turn that differs; beyond the shorter side if none does
    differs = F.filter(F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.element_at("chosen", i) != F.element_at("rejected", i))
    shared = F.coalesce(F.get(differs, F.lit(0)) - 1, both)
    rows = (pairs.filter(F.col("pair_id").isNotNull() & (F.col("chosen") != F.col("rejected")))
            .withColumn("n_prompt_turns", shared))
    n = F.col("n_prompt_turns")
    out = [F.array_join(F.transform(F.slice("chosen", 1, n), rendered), "").alias("prompt")]
    for side in ("chosen", "rejected"):
        text, spans = _completion(F.slice(side, n + 1, F.size(side)))
        out += [text.alias(side), spans.alias(f"{side}_mask")]
    return rows.select("pair_id", "n_prompt_turns", *out)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Formats rows (pair_id, side, turn, role, text), where side is `chosen` or `rejected`."""
    sides = (turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
             .groupBy("pair_id", "side").agg(_turns().alias("turns")))
    pairs = sides.groupBy("pair_id").agg(
        *[F.max(F.when(F.col("side") == side, F.col("turns"))).alias(side) for side in ("chosen", "rejected")])
    return formatted(pairs.filter("chosen IS NOT NULL AND rejected IS NOT NULL"))


def made_pairs(conversations: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text) of pairs made from single conversations (conv_id,
    turn, role, text). Chosen: the conversation. Rejected: the same, but one of its answers,
    which the id picks, repeats the text before it (nothing, if it comes first); the turns
    after it stay. Conversations without an answer give no pair; if the picked answer repeats
    the text before it anyway, the sides are equal."""
    rows = (conversations.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")).distinct())
    whole = Window.partitionBy("pair_id")
    order = whole.orderBy(F.asc_nulls_last("turn"), "role", "text")
    answer = (F.col("role") == TRAINED_ROLE).cast("int")
    numbered = rows.select(
        "pair_id", "role", "text", F.row_number().over(order).alias("place"),
        F.lag("text", 1, "").over(order).alias("before"), F.sum(answer).over(order).alias("answer"),
        F.sum(answer).over(whole).alias("answers")).filter("answers > 0")
    picked = F.crc32(F.col("pair_id").cast("string").cast("binary")) % F.col("answers") + 1
    wrong = F.when((F.col("role") == TRAINED_ROLE) & (F.col("answer") == picked), F.col("before")).otherwise(F.col("text"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col("place").alias("turn"), F.col("role"), text.alias("text"))
                      for side, text in (("chosen", F.col("text")), ("rejected", wrong))])
    return numbered.select("pair_id", F.inline(sides))
