"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The prompt is the longest prefix of turns that both sides share (same role, same text), rendered
once.  Each completion renders the turns after it; its mask lists the code-point ranges that
assistant turns wrote, the only ones a loss should see.

Only DataFrame functions are used.  There is one shuffle, by pair; a pair's row holds its two
conversations, as its result must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _render(turn):
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def _mask(turns):
    """Ranges start:end of the assistant's texts in the rendering of ``turns``, comma-joined."""

    def step(acc, turn):
        size, role = F.length(_render(turn)), F.coalesce(turn["role"], F.lit(""))
        low = acc["at"] + F.length(role) + F.lit(5)
        own = F.concat(low.cast("string"), F.lit(":"), (acc["at"] + size - F.lit(1)).cast("string"))
        more = F.when(role == "assistant", F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise(","), own)).otherwise(acc["out"])
        return F.struct((acc["at"] + size).alias("at"), more.alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """From rows pair_id, side ('chosen' or 'rejected'), turn, role, text: pair_id, n_prompt_turns, n_chosen_turns,
    n_rejected_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Defined results: turns are ordered by turn, then role, then text, so ties and repeated rows
    have one order; null role and text render as empty but differ from an empty string when turns are
    compared; a side without turns has an empty completion, and the prompt is then empty; rows
    with a null pair_id form no pair and are left out; other columns are ignored.
    """
    both = turns.where("pair_id is not null").groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", F.col("text").cast("string").alias("text"))))).alias(side) for side in ("chosen", "rejected")))
    same = F.zip_with("chosen", "rejected", lambda c, r: c["role"].eqNullSafe(r["role"]) & c["text"].eqNullSafe(r["text"]))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    split = F.array_position(same, False).cast("int")
    n = F.when(split > 0, F.least(split - 1, shorter)).otherwise(shorter)
    cut = both.withColumn("n_prompt_turns", n)
    rest = {side: F.slice(F.col(side), F.col("n_prompt_turns") + 1, F.size(side)) for side in ("chosen", "rejected")}
    text = lambda part: F.array_join(F.transform(part, _render), "")
    return cut.select(
        "pair_id", "n_prompt_turns", *((F.size(side) - F.col("n_prompt_turns")).alias(f"n_{side}_turns") for side in rest),
        text(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"), *(text(rest[side]).alias(side) for side in rest), *(_mask(rest[side]).alias(f"{side}_mask") for side in rest),
    )


def preference_query(spark, sf_dir: str) -> DataFrame:
    """op8: conversations 2k and 2k+1 as the chosen and the rejected side of pair k."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return format_preferences(turns.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), side.alias("side"), "turn", "role", "text"))


PREFERENCE_SQL = r"""
with t as (
  select cast(floor(conv_id / 2) as bigint) pair_id, conv_id % 2 side, role, text,
         row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) i
  from conversations where conv_id is not null
), m as (
  select coalesce(a.pair_id, b.pair_id) pair_id, coalesce(a.i, b.i) i,
         a.i is not null and b.i is not null and a.role is not distinct from b.role and a.text is not distinct from b.text same
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.i = b.i
), p as (
  select pair_id, coalesce(min(case when not same then i end) - 1, max(i)) n from m group by pair_id
), r as (
  select t.pair_id, t.side, t.i, p.n, coalesce(role, '') rl, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) s
  from t join p on t.pair_id = p.pair_id
), o as (
  select *, coalesce(sum(length(s)) over (partition by pair_id, side, i > n order by i rows between unbounded preceding and 1 preceding), 0) low from r
)
select pair_id, cast(any_value(n) as int) n_prompt_turns,
       cast(count(*) filter (side = 0 and i > n) as int) n_chosen_turns, cast(count(*) filter (side = 1 and i > n) as int) n_rejected_turns,
       coalesce(string_agg(s, '' order by i) filter (side = 0 and i <= n), '') prompt,
       coalesce(string_agg(s, '' order by i) filter (side = 0 and i > n), '') chosen,
       coalesce(string_agg(s, '' order by i) filter (side = 1 and i > n), '') rejected,
       coalesce(string_agg(cast(low + length(rl) + 5 as bigint) || ':' || cast(low + length(s) - 1 as bigint), ',' order by i) filter (side = 0 and i > n and rl = 'assistant'), '') chosen_mask,
       coalesce(string_agg(cast(low + length(rl) + 5 as bigint) || ':' || cast(low + length(s) - 1 as bigint), ',' order by i) filter (side = 1 and i > n and rl = 'assistant'), '') rejected_mask
from o group by pair_id
"""
