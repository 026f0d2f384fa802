"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of the two conversations is rendered once as the prompt; what follows is
rendered as a pair of completions, each with a mask: the half-open code point ranges of assistant texts and
their end marks, on which a loss is taken.

Scale: turns meet by pair key in one shuffle for each side and the sides by a join; a conversation becomes one
row, as any rendering of it must.

Defined cases: a null role is "unknown", a null text empty, null turns come first; turns of one number are
ordered by role and text, repeated rows are repeated turns; a null key is a key like any other; a pair that lacks one side has
an empty one there; equal conversations have all turns in the prompt and empty completions; a pair with an empty completion
teaches no preference and is marked as degenerate; very long texts are parts of one row; extra columns are not read, so their
names don't matter; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import let

#: Marks around a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, key: str, name: str) -> DataFrame:
    """key and an array of (role, text) in turn order."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    return whole.select(key, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def last_replaced_by_first(turns: DataFrame, key: str, by: str = "assistant") -> DataFrame:
    """key, turn, role and text of conversations up to the last turn of ``by``, whose text is that of their first turn of ``by``.

    First and last go by turn, role and text, so equal numbers have a defined order and only one row is replaced; a conversation
    without such a turn has no rows.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = turns.select(key, "turn", role.alias("role"), text.alias("text"), F.row_number().over(W.partitionBy(key).orderBy("turn", role, text)).alias("_at"))
    own, whole = F.when(F.col("role") == by, F.col("_at")), W.partitionBy(key)
    rows = rows.withColumn("_last", F.max(own).over(whole)).withColumn("_first", F.min_by("text", own).over(whole))
    return rows.filter("_at <= _last").select(key, "turn", "role", F.when(F.col("_at") == F.col("_last"), F.col("_first")).otherwise(F.col("text")).alias("text"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def loss_ranges(turns: Column, trained: str = "assistant") -> Column:
    """Array of (from, to): the ranges of the rendered turns that count for the loss."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("ranges"))

    def step(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        own = F.array(F.struct(begin.cast("bigint").alias("from"), end.cast("bigint").alias("to")))
        return F.struct(end.cast("bigint").alias("at"), F.when(t["role"] == trained, F.concat(seen["ranges"], own)).otherwise(seen["ranges"]).alias("ranges"))

    return F.aggregate(turns, first, step, lambda seen: seen["ranges"])


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both begin with."""
    same = F.zip_with(a, b, lambda x, y: (x["role"].eqNullSafe(y["role"])) & (x["text"].eqNullSafe(y["text"])))
    return let(same, lambda s: F.when(F.array_position(s, False) == 0, F.size(s)).otherwise(F.array_position(s, False) - 1).cast("int"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, n_common, prompt, chosen, rejected, the ranges chosen_loss and rejected_loss, and degenerate.

    Both inputs have key, turn, role and text.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    left, right = conversations(chosen, key, "_c"), conversations(rejected, key, "_r").withColumnRenamed(key, "_key")
    both = left.join(right, left[key].eqNullSafe(right["_key"]), "full")
    both = both.select(F.coalesce(key, "_key").alias(key), F.coalesce("_c", none).alias("_c"), F.coalesce("_r", none).alias("_r"))
    both = both.withColumn("n_common", common_turns(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    both = both.select(key, "n_common", render(F.slice("_c", F.lit(1), F.col("n_common"))).alias("prompt"), rest("_c").alias("_c"), rest("_r").alias("_r"))
    return both.select(
        key,
        F.col("n_common").cast("bigint").alias("n_common"),
        "prompt",
        render(F.col("_c")).alias("chosen"),
        render(F.col("_r")).alias("rejected"),
        loss_ranges(F.col("_c")).alias("chosen_loss"),
        loss_ranges(F.col("_r")).alias("rejected_loss"),
        ((F.size("_c") == 0) | (F.size("_r") == 0)).alias("degenerate"),
    )
