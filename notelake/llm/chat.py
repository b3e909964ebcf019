"""Preference formatting of conversation pairs, in DataFrame operations only.

The two sides of a pair are compared turn by turn; the first turn that differs ends their longest common prefix. The prefix is
rendered once as the prompt (masked from the loss), the rest of either side as a completion in which only the assistant's
words count. Pairs are two conversations each (sides_of), or a conversation and its own weaker answer (weakened): the same turns up to
its last assistant turn, whose text is cut to the first half of its words.

The turns of a conversation lie in blocks of 64 turn numbers, and a pair gives one row a block with prompt, chosen and rejected of
that block: one row for pairs of ordinary length, and never more than a block in a task for a conversation of any length.

Defined results: repeated rows count once; a null turn is -1, null role and text are empty; rows of one turn number are numbered by role, then text (k),
and those beyond the 64th of a number stand after the rest of their block, 64 at a time; null conv_ids and pairs whose conversations are
missing give nothing for that side; pairs that are equal throughout have a prompt only; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
BLOCK = 64
_SPANS = "array<struct<start:int,end:int>>"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _turns(turns: DataFrame) -> DataFrame:
    """conv, turn, k, role, text of distinct rows, nulls replaced."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("conv is not null").distinct()
    return t.withColumn("k", F.row_number().over(W.partitionBy("conv", "turn").orderBy("role", "text")))


def sides_of(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, side, turn, k, role, text of pairs (pair_id, chosen, rejected) of conversations."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("conv"))
    s = pairs.select("pair_id", F.explode(F.array(side("chosen"), side("rejected"))).alias("s")).select("pair_id", "s.side", "s.conv")
    return s.join(_turns(turns), "conv").select("pair_id", "side", "turn", "k", "role", "text")


def _place() -> Column:
    """Order of turns: block of turn numbers, then of k, then turn and k."""
    return F.struct(F.floor(F.col("turn") / BLOCK).alias("block"), F.floor((F.col("k") - 1) / BLOCK).alias("part"), F.col("turn"), F.col("k"))


def weakened(turns: DataFrame) -> DataFrame:
    """pair_id (the conversation), side, turn, k, role, text: each conversation, and itself up to its last assistant turn with
    half of that answer. One without an assistant turn is equal on both sides."""
    t = _turns(turns).withColumn("at", _place())
    last = t.where("role = 'assistant'").groupBy(F.col("conv").alias("c2")).agg(F.max("at").alias("last"))
    t = t.join(last, F.col("conv") == F.col("c2"), "left")
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.expr("size(split(text, ' ')) div 2").cast("int")), " ")
    chosen = t.select(F.col("conv").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "k", "role", "text")
    weak = t.where("last is null or at <= last").select(
        F.col("conv").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "k", "role",
        F.when(F.col("at") == F.col("last"), half).otherwise(F.col("text")).alias("text"),
    )
    return chosen.unionByName(weak)


def _rendered(x: Column) -> Column:
    return F.concat(header(x["role"]), x["text"], F.lit(CLOSE + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _masks(turns: Column) -> Column:
    """Trained intervals of the joined text: the assistant's words with their end mark."""
    state = f"struct<at:int,out:{_SPANS}>"
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out")).cast(state)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(header(x["role"]))
        span = F.struct(start.alias("start"), (start + F.length(x["text"]) + len(CLOSE)).alias("end"))
        out = F.when(x["role"] == "assistant", F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(_rendered(x))).alias("at"), out.alias("out")).cast(state)

    return F.aggregate(turns, zero, step, lambda a: a["out"])


def preference_format(sides: DataFrame) -> DataFrame:
    """pair_id, block, part, n_prompt, n_chosen, n_rejected (turns), prompt, chosen, rejected, chosen_spans, rejected_spans. Spans are the
    trained intervals of a completion; the prompt has none."""
    said = F.struct("role", "text")
    of = lambda side: F.max(F.when(F.col("side") == side, said)).alias(side)
    cell = sides.groupBy("pair_id", "turn", "k").agg(of("chosen"), of("rejected")).withColumn("at", _place())
    first = cell.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy(F.col("pair_id").alias("p2")).agg(F.min("at").alias("first"))
    parted = cell.join(first, F.col("pair_id") == F.col("p2"), "left").withColumn("common", F.col("first").isNull() | (F.col("at") < F.col("first")))
    rows = parted.groupBy("pair_id", "at.block", "at.part").agg(F.array_sort(F.collect_list(F.struct("at", "common", "chosen", "rejected"))).alias("t"))
    pick = lambda keep, side: F.transform(F.filter("t", keep), lambda x: x[side])
    rows = rows.select(
        "pair_id", "block", "part", pick(lambda x: x["common"], "chosen").alias("p"),
        pick(lambda x: ~x["common"] & x["chosen"].isNotNull(), "chosen").alias("c"), pick(lambda x: ~x["common"] & x["rejected"].isNotNull(), "rejected").alias("r"),
    )
    n = lambda c: F.size(c).cast("long")
    return rows.select(
        "pair_id", "block", "part", n("p").alias("n_prompt"), n("c").alias("n_chosen"), n("r").alias("n_rejected"),
        _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"),
        _masks(F.col("c")).alias("chosen_spans"), _masks(F.col("r")).alias("rejected_spans"),
    )
