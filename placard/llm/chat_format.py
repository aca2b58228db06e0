"""Chat formatting by rotation of perspective.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users. The mask holds the
spans (code points, end exclusive) that a model learns: the speaker's own texts
with their end mark. Turns of an instruction role stay what they are and are
nobody's perspective.

A rendering is made in parts of at most ``part_turns`` turns, so a conversation
of any length is spread over tasks; a part's ``start`` is its offset in the
whole rendering, and its masks count from there. Parts in order make the whole.
Where a part begins comes from the turns' lengths alone. So each text is
shuffled once, by conversation and cut, and rendered only at the end.

Edge cases: turns are ordered by turn (null first), role and text, so ties and
repeated rows have a fixed order and all appear; a null role is "unknown", a
null text is empty; rows without conv_id belong to no conversation and are left
out; the template's marks within a text get a space and so can't end a turn; a
conversation of instructions only has no rendering; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import only, table

START, END = "<|im_start|>", "<|im_end|>"


def _cut(turns: DataFrame, part_turns: int) -> DataFrame:
    """turns with a: the coarse cut of a conversation, by turn number."""
    return turns.withColumn("a", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 60))))


def _head(role: Column, instructions: tuple[str, ...]) -> Column:
    """How a turn of another speaker is headed."""
    return F.when(role.isin(*instructions), role).otherwise(F.concat(F.lit("user name="), role))


def _starts(turns: DataFrame, instructions: tuple[str, ...], part_turns: int) -> DataFrame:
    """conv_id, a and sides: for each participant where its rendering of the cut begins, in characters and parts.

    Reads lengths only; sums for each cut and role come before the shuffle.
    """
    around = len(START) + len(END) + 2  # with the two line ends
    light = turns.groupBy("conv_id", "a", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    light = light.withColumn("base", F.col("n") * (F.length(_head(F.col("role"), instructions)) + around) + F.col("chars"))
    before = lambda c, by: f"coalesce(sum({c}) over (partition by {by} order by a rows between unbounded preceding and 1 preceding), 0)"
    cuts = light.groupBy("conv_id", "a").agg(F.sum("base").alias("base"), F.ceil(F.sum("n") / part_turns).alias("parts")).selectExpr("conv_id", "a", f"{before('base', 'conv_id')} as start", f"{before('parts', 'conv_id')} as part")
    spoken = light.filter(~F.col("role").isin(*instructions)).select("conv_id", "a", F.col("role").alias("participant"), "n")
    grid = cuts.join(spoken.select("conv_id", "participant").distinct(), "conv_id").join(spoken, ["conv_id", "a", "participant"], "left")
    own = f"{before('n', 'conv_id, participant')} * (length('assistant') - length(concat('user name=', participant)))"
    return grid.selectExpr("conv_id", "a", f"struct(participant, start + {own} as start, part) as side").groupBy("conv_id", "a").agg(F.collect_list("side").alias("sides"))


def rotate(conversations: DataFrame, instructions: tuple[str, ...] = ("system",), part_turns: int = 64) -> DataFrame:
    """conv_id, participant, part, n_turns, start, text, masks (array of start, end) for conversations (conv_id, turn, role, text)."""
    clean = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    marked = clean.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_(start|end)\|>", "<| im_$1|>").alias("text"))
    turns = _cut(marked, part_turns)
    # Many rows of one turn number make more than one part of a cut: b, by their rank.
    ranked = turns.withColumn("rank", F.expr("row_number() over (partition by conv_id, a order by turn nulls first, role, text)")).withColumn("b", F.floor((F.col("rank") - 1) / part_turns))
    parts = ranked.groupBy("conv_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    sided = parts.join(_starts(turns, instructions, part_turns), ["conv_id", "a"]).select("conv_id", "a", "b", "turns", F.explode("sides").alias("s")).select("conv_id", "a", "b", "turns", "s.*")
    head = lambda t: F.when(t["role"] == F.col("participant"), "assistant").otherwise(_head(t["role"], instructions))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(head(t)) + F.length(t["text"]) + (len(START) + len(END) + 2))
    placed = sided.withColumn("size", size).withColumn("start", F.expr("cast(start + sum(size) over (partition by conv_id, a, participant order by b rows between unbounded preceding and current row) - size as bigint)"))
    masks = F.aggregate(
        "turns",
        F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["text"]) + (len(START) + len(END) + 2)).cast("long").alias("at"),
            F.when(t["role"] == F.col("participant"), F.array_append(acc["spans"], F.struct((acc["at"] + F.length(head(t)) + len(START) + 1).cast("long").alias("start"), (acc["at"] + F.length(head(t)) + F.length(t["text"]) + (len(START) + len(END) + 1)).cast("long").alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), head(t), F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    return placed.select("conv_id", "participant", (F.col("part") + F.col("b")).cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"), "start", text.alias("text"), masks.alias("masks"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.array_join(F.transform("masks", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "participant", "part", "n_turns", "start", F.sha2("text", 256).alias("text_sha256"), masks.alias("masks"))


OP3_SQL = f"""
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as body from conversations),
s as (select distinct conv_id, role as participant from t where role <> 'system'),
r as (select conv_id, participant, turn, role, body, role = participant as own,
        '{START}' || case when role = participant then 'assistant' when role = 'system' then role else 'user name=' || role end || chr(10) as head,
        body || '{END}' as said from t join s using (conv_id)),
o as (select *, sum(length(head) + length(said) + 1) over (partition by conv_id, participant order by turn nulls first, role, body rows between unbounded preceding and current row) as upto from r)
select conv_id, participant, 0::bigint as part, count(*) as n_turns, 0::bigint as start,
       sha256(string_agg(head || said || chr(10), '' order by turn nulls first, role, body)) as text_sha256,
       coalesce(string_agg(case when own then (upto - length(said) - 1) || ':' || (upto - 1) end, ',' order by upto), '') as masks
from o group by conv_id, participant
"""
