"""Chat formatting by perspective rotation for dialogues of several speakers.

For every speaker of a conversation the whole dialogue is rendered once with that speaker as the assistant, all
others as named users, and system turns as they are. The mask covers what the model is trained to produce:
the speaker's own texts with their end marks.

Renderings of a dialogue differ only in the heads of the speaker's own turns. So the place of every turn is summed
up once, over all turns with named heads, and is corrected for a speaker by the number of own turns before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def rotations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """Returns (conv_id, speaker, n_turns, text, mask) for every conversation and speaker.

    ``mask`` is an array of (start, end) in characters of the row's text. Turns are ordered by number, then
    role, then text; rows that are equal in all four are one turn. A null text is an empty one, a null role
    is the speaker "unknown", a null number comes first, and null conversation ids are one conversation. Marks
    of the format inside a text are broken up by a space, and white space in a name becomes an underscore. A
    conversation of system turns only has no speaker and no row; an empty table gives none. Other columns are
    dropped, whatever their names.

    A rendering is one value, so a dialogue of any length is one row for each speaker, up to Spark's limit of 2 GB
    for a value; the work is linear in its length.
    """
    name = F.coalesce(F.regexp_replace(F.trim(F.col(role).cast("string")), r"\s+", "_"), F.lit("unknown"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for mark in (START, END):
        body = F.replace(body, F.lit(mark), F.lit("< " + mark[1:]))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), name.alias("role"), body.alias("body")
    ).distinct()

    user, own, marks = "user name=", "assistant", len(START) + len("\n")
    head = lambda r: F.when(r == system, F.lit(system)).otherwise(F.concat(F.lit(user), r))
    width = marks + F.char_length(head(F.col("role"))) + F.char_length("body") + len(END) + len("\n")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("conv_id", "role").orderBy("turn", "body")
    rows = rows.withColumn("gone", F.coalesce(F.sum(width).over(order), F.lit(0))).withColumn("before", F.row_number().over(mine) - 1)
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "gone", "before"))).alias("turns"))
    speakers = F.filter(F.array_distinct(F.transform("turns", lambda t: t["role"])), lambda r: r != system)
    views = whole.select("conv_id", "turns", F.explode(speakers).alias("speaker"))

    def part(t):
        shown = F.when(t["role"] == F.col("speaker"), F.lit(own)).otherwise(head(t["role"]))
        return F.concat(F.lit(START), shown, F.lit("\n"), t["body"], F.lit(END), F.lit("\n"))

    def span(t):
        start = t["gone"] + t["before"] * (F.lit(len(own) - len(user)) - F.char_length("speaker")) + marks + len(own)
        return F.struct(start.alias("start"), (start + F.char_length(t["body"]) + len(END)).alias("end"))

    mask = F.transform(F.filter("turns", lambda t: t["role"] == F.col("speaker")), span)
    rendered = F.array_join(F.transform("turns", part), "")
    return views.select("conv_id", "speaker", F.size("turns").cast("long").alias("n_turns"), rendered.alias("text"), mask.alias("mask"))


#: The rows of the registered query by DuckDB.
ORACLE = r"""
with t as (
  select distinct conv_id, coalesce(turn, -1) as turn, coalesce(regexp_replace(trim(role), '\s+', '_', 'g'), 'unknown') as role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') as body
  from conversations),
s as (select distinct conv_id as conv, role as speaker from t where role <> 'system'),
v as (
  select conv_id, speaker, turn, role, body, role = speaker as mine,
         '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
         body || '<|im_end|>' as rest
  from t join s on conv_id is not distinct from conv),
o as (
  select *, coalesce(sum(length(head) + length(rest) + 1) over (partition by conv_id, speaker order by turn, role, body rows between unbounded preceding and 1 preceding), 0) as gone from v)
select conv_id, speaker, count(*) as n_turns, string_agg(head || rest || chr(10), '' order by turn, role, body) as text,
       coalesce(string_agg(case when mine then cast(gone + length(head) as bigint) || '-' || cast(gone + length(head) + length(rest) as bigint) end, ',' order by turn, role, body), '') as mask
from o group by conv_id, speaker
"""
