"""Preference pairs as one prompt and two masked completions.

Input: turns ``(pair_id, side, turn, role, text)`` with side ``chosen`` or
``rejected``.  The longest common prefix of turns (equal role and text) is the
prompt, rendered once; the rest of each side is its completion.  A completion's
mask lists the stretches to train on: the text and end mark of its assistant
turns (code points of the rendered completion, end exclusive).

Defined cases: a null role or text counts as empty; turns are ordered by
``turn`` (null first), then role and text, so ties and repeated rows have one
order and each is rendered; a side without turns has an empty completion;
equal sides are all prompt; rows of another side are ignored, and a pair with
no row on either side does not appear; rows with a null ``pair_id`` form one
pair under null; marks inside a text are broken by a space; texts of any
length are rendered whole; columns other than those named are not read, so their
names cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import running
from .text import indices, let, whole

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(whole(text), F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    sizes = F.transform(turns, lambda t: F.length(_head(t)) + F.length(t["text"]) + len(CLOSE) + 1)
    placed = let(running(sizes, lambda a, b: a + b), lambda at: F.zip_with(at, turns, lambda a, t: F.struct(
        (a + F.length(_head(t))).alias("start"),
        (a + F.length(_head(t)) + F.length(t["text"]) + len(CLOSE)).alias("end"),
        (t["role"] == TRAINED_ROLE).alias("trained"))))
    return F.transform(F.filter(placed, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["end"]))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)``, a row per pair."""
    turn = F.struct(F.col("turn"), _safe(F.col("role")).alias("role"), _safe(F.col("text")).alias("text"))

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)

    pairs = turns.where(F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    pairs = pairs.withColumn("n_prompt_turns", F.when(first_other > 0, first_other - 1)
                             .otherwise(F.size("chosen")).cast("int"))

    def rest(name: str) -> Column:
        n = F.col("n_prompt_turns")
        return F.transform(indices(F.size(name) - n), lambda i: F.get(F.col(name), i + n))

    pairs = pairs.select("pair_id", "n_prompt_turns",
                         F.slice("chosen", F.lit(1), F.col("n_prompt_turns")).alias("prompt_turns"),
                         rest("chosen").alias("chosen_turns"), rest("rejected").alias("rejected_turns"))
    return pairs.select("pair_id", "n_prompt_turns", _rendered(F.col("prompt_turns")).alias("prompt"), *[
        x for side in ("chosen", "rejected") for x in (
            _rendered(F.col(f"{side}_turns")).alias(side), _mask(F.col(f"{side}_turns")).alias(f"{side}_mask"))])


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
