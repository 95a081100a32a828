"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_snapshots (logged conversations it stands for), text, of each maximal conversation.

    A conversation is dropped if its turns are a proper prefix of another's;
    of equal ones that with the smallest conv_id stays.  The rolling hash of a
    prefix is the running XOR of two 64-bit hashes of (position, role, text),
    so that every prefix of every conversation costs one row and nothing is
    concatenated; prefixes are taken as equal if length and both hashes are.
    Whole conversations and proper prefixes are each aggregated by (length,
    hashes) before the anti-join: however many copies of a conversation were
    logged, a key has one row on either side.

    Turns are ordered by turn, then role and text; null turns come first.  Null
    roles and texts count as empty.  Repeated rows count once.  Rows with a null
    conv_id belong to no conversation.  Empty tables give no rows; other columns
    are not read.
    """
    t = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text")
    ).where("conv_id is not null")
    t = t.groupBy("conv_id", "turn", F.xxhash64("role", "text").alias("same"), "role", "text").agg(F.lit(1).alias("one")).drop("same", "one")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = t.select("conv_id", "turn", F.xxhash64("role", "text").alias("x"), F.xxhash64("text", "role", F.lit(7)).alias("y"), "role", "text")
    numbered = numbered.withColumn("pos", F.row_number().over(order))
    hashed = numbered.withColumns({"x": F.xxhash64("pos", "x"), "y": F.xxhash64("y", "pos")})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = hashed.select("conv_id", "pos", F.bit_xor("x").over(upto).alias("hx"), F.bit_xor("y").over(upto).alias("hy"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    keys = ["pos", "hx", "hy"]
    whole = prefixes.where("n = pos").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = prefixes.where("n > pos").select(*keys).distinct()
    kept = whole.join(longer, keys, "left_anti").select("conv_id", "copies")
    rendered = (
        numbered.join(kept, "conv_id")
        .groupBy("conv_id", "copies")
        .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
        .select("conv_id", "n_turns", F.col("copies").alias("n_snapshots"), F.concat_ws("", F.transform("turns", lambda x: render_turn(x["role"], x["text"]))).alias("text"))
    )
    return rendered


def render_turn(role, text):
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


ORACLE = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, count(*) as n_turns,
        string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by turn nulls first, role, text) as text
      from t group by conv_id),
p as (select conv_id, row_number() over o as pos,
        sha256(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '') over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)) as h,
        count(*) over (partition by conv_id) as n
      from t window o as (partition by conv_id order by turn nulls first, role, text)),
s as (select pos, h, max(n) as longest, min(case when n = pos then conv_id end) as first_id, count(case when n = pos then 1 end) as copies from p group by pos, h)
select c.conv_id, c.n_turns, s.copies as n_snapshots, c.text
from c join p on p.conv_id = c.conv_id and p.n = p.pos join s on s.pos = p.pos and s.h = p.h
where s.longest = s.pos and s.first_id = c.conv_id
"""
