"""Chat formatting: logged snapshots that begin longer conversations are dropped, and the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from octarine.llm.common import cut, table

#: Turns in one part of a rendered conversation: a longer one comes as several rows.
PART = 256
#: Turns whose hashes one task adds up at once.
CHUNK = 4096
#: Characters of role and text that order turns of one number, before all of them do; these bound what a range sort samples.
PREFIX = 64
#: How a turn is rendered.
OPEN, CLOSE, AFTER = "<|", "|>\n", "\n"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, t1 and t2 (hashes of the two, nulls apart from any text) and number: consecutive in each conversation.

    Turns are in the order of turn (nulls first), then of the first PREFIX characters of role and of text, then of all of them.
    The order is that of a range sort, which splits a long conversation over tasks; only each partition's size reaches the driver.
    """
    keys = ["conv_id", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)]
    own = turns.select("conv_id", "turn", "role", "text")
    placed = own.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text").withColumn("at", F.monotonically_increasing_id())
    said = lambda *seed: F.xxhash64(*map(F.lit, seed), F.col("role").isNull(), F.col("text").isNull(), "role", "text")
    placed = cut(placed.select("conv_id", "role", "text", said().alias("t1"), said("second").alias("t2"), F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    offsets, so_far = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r.part, so_far))
        so_far += r.n
    known = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.join(known, "part").select("conv_id", "role", "text", "t1", "t2", (F.col("before") + F.col("at")).alias("number"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def prefixes(said: DataFrame) -> DataFrame:
    """conv_id, at, n_turns, h1 and h2 from numbered(): a turn's place from 1, and the rolling hashes of all turns up to it.

    A turn's hash depends on its place; the rolling hash is the xor of those so far: within CHUNK turns first, then
    with what the chunks before give, so that no long conversation is summed by one task.
    """
    own = said.select("conv_id", "number", "t1", "t2")
    ends = cut(own.groupBy("conv_id").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_turns"))).withColumnRenamed("conv_id", "of")
    placed = own.join(ends, _same("conv_id", "of")).withColumn("at", F.col("number") - F.col("first") + 1)
    hashed = placed.select("conv_id", "at", "n_turns", F.floor((F.col("at") - 1) / CHUNK).alias("chunk"), F.xxhash64("at", "t1").alias("x1"), F.xxhash64("t2", "at").alias("x2"))
    up_to = W.partitionBy("conv_id", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    within = cut(hashed.withColumns({"x1": F.bit_xor("x1").over(up_to), "x2": F.bit_xor("x2").over(up_to)}))
    last = within.where((F.col("at") % CHUNK == 0) & (F.col("at") < F.col("n_turns")))  # chunks that others follow: few, as most conversations have one
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    so_far = cut(last.select(F.col("conv_id").alias("of"), (F.col("chunk") + 1).alias("next"), F.bit_xor("x1").over(before).alias("y1"), F.bit_xor("x2").over(before).alias("y2")))
    met = within.join(so_far, _same("conv_id", "of") & (F.col("chunk") == F.col("next")), "left")
    none = F.lit(0).cast("bigint")
    return met.select("conv_id", "at", "n_turns", F.col("x1").bitwiseXOR(F.coalesce("y1", none)).alias("h1"), F.col("x2").bitwiseXOR(F.coalesce("y2", none)).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, at, role, text, n_turns, n_alike) of conversations that begin no longer one; of equal ones that of the least conv_id, null first.

    A conversation begins another if the other's first turns are all of its own, by role and text; the number of
    a turn only orders them. n_alike counts the equal conversations, the one kept included. A null role or text
    equals a null alone; the rows with a null conv_id are one conversation; repeated rows are turns of their own; other columns are ignored.
    """
    said = numbered(turns)
    rolled = cut(prefixes(said))
    whole = rolled.where("at = n_turns").groupBy("n_turns", "h1", "h2")
    whole = whole.agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("c"), F.count(F.lit(1)).alias("n_alike"))
    begun = rolled.where("at < n_turns").select(F.col("at").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(begun, ["n_turns", "h1", "h2"], "left_anti").select(F.col("c.conv_id").alias("of"), "n_turns", "n_alike")
    first = said.groupBy(F.col("conv_id").alias("by")).agg(F.min("number").alias("first"))
    chosen = cut(kept.join(first, _same("of", "by")).select("of", "first", "n_turns", "n_alike"))
    return said.join(chosen, _same("conv_id", "of")).select("conv_id", (F.col("number") - F.col("first") + 1).alias("at"), "role", "text", "n_turns", "n_alike")


def render(turns: DataFrame, most: int = PART) -> DataFrame:
    """conv_id, part, n_turns, n_alike and chat: the turns of maximal() as text, at most so many to a row; part counts a conversation's rows from 0.

    Each turn gives <|role|>, a line end, its text and another; a null counts as empty. The parts joined are the whole conversation.
    """
    shown = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE), F.coalesce("text", F.lit("")), F.lit(AFTER))
    lines = F.sort_array(F.collect_list(F.struct("at", shown.alias("shown"))))
    rows = turns.groupBy("conv_id", F.floor((F.col("at") - 1) / most).alias("part"), "n_turns", "n_alike").agg(lines.alias("lines"))
    return rows.select("conv_id", "part", "n_turns", "n_alike", F.array_join("lines.shown", "").alias("chat"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(table(spark, sf_dir, "conversations")))


OP5_SQL = r"""
with t as (select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn nulls first, left(role, 64) nulls first, left(text, 64) nulls first, role nulls first, text nulls first) k from conversations),
c as (select conv_id, list({'r': role, 't': text} order by k) l, count(*) n from t group by conv_id),
f as (select l, n, min(conv_id) conv_id, count(*) n_alike from c group by l, n),
m as (select * from f where not exists (select 1 from c where c.n > f.n and list_slice(c.l, 1, f.n) = f.l))
select t.conv_id, ((t.k - 1) // 256)::bigint part, m.n::bigint n_turns, m.n_alike::bigint n_alike,
  string_agg('<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10), '' order by t.k) chat
from m join t on t.conv_id = m.conv_id group by all
"""
