"""Chat formatting after the collapse of cumulative snapshots.

A logged conversation that another one continues turn by turn is a snapshot of it. Rolling hashes of each conversation's
prefixes meet the whole hashes of others: an anti-join retains what is no proper prefix, and of equal ones the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .spans import CHUNK, let

#: Marks around a role, and after a turn; where a role or a text has the first one in it, it is written otherwise, so that no
#: text can pass for a turn.
TEMPLATE, ESCAPED = ("<|", "|>\n", "\n"), "<\\|"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order of turn, then role and text where turns tie; exact repeats of a row count once.
    Null role or text: empty. Rows of null conv_id belong to no conversation and are left out."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def with_prefixes(convs: DataFrame) -> DataFrame:
    """Adds hashes: hashes[i] is of the first i + 1 turns, each from the one before and the turn. The turns are taken in chunks,
    so that a very long conversation costs no square of its length."""
    said = lambda t: F.concat_ws(":", F.length(t["role"]).cast("string"), t["role"], t["text"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / CHUNK).cast("int")), lambda k: F.slice("turns", k * CHUNK + 1, F.lit(CHUNK)))

    def turn(acc: Column, t: Column) -> Column:
        return let(F.sha2(F.concat(acc["last"], said(t)), 256), lambda h: F.struct(h.alias("last"), F.concat(acc["out"], F.array(h)).alias("out")))

    def chunk(acc: Column, turns: Column) -> Column:
        own = F.aggregate(turns, F.struct(acc["last"].alias("last"), F.array().cast("array<string>").alias("out")), turn)
        return let(own, lambda x: F.struct(x["last"].alias("last"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("out"))
    return convs.withColumn("hashes", F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["out"])))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_copies): conversations that no other one continues, the least id of equal ones."""
    every = saved(with_prefixes(turns_of(conversations)).withColumn("n_turns", F.size("turns")), "conversations")
    proper = every.select(F.explode(F.slice("hashes", 1, F.col("n_turns") - 1)).alias("whole")).distinct()
    own = every.select("conv_id", "turns", "n_turns", F.element_at("hashes", -1).alias("whole"))
    first = own.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")).join(proper, "whole", "left_anti")
    return own.drop("whole").join(first.drop("whole"), "conv_id")


def render(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): one string for each conversation."""
    a, b, c = TEMPLATE
    plain = lambda x: F.replace(x, F.lit(a), F.lit(ESCAPED))
    chat = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(a), plain(t["role"]), F.lit(b), plain(t["text"]), F.lit(c))), "")
    return convs.select("conv_id", "n_turns", "n_copies", chat.alias("chat"))


def op9(conversations: DataFrame) -> DataFrame:
    return render(maximal(conversations))


OP9_SQL = """
WITH rows_ AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM rows_ GROUP BY conv_id
), firsts AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY turns
), prefixes AS (
  SELECT DISTINCT turns[1:i] AS turns FROM convs, LATERAL (SELECT unnest(range(1, len(turns))) AS i)
)
SELECT conv_id, CAST(len(turns) AS INTEGER) AS n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda t: '<|' || replace(t.role, '<|', '<\\|') || '|>' || chr(10) || replace(t.text, '<|', '<\\|') || chr(10)), 'string_agg', '') AS chat
FROM firsts WHERE turns NOT IN (SELECT turns FROM prefixes)
"""
