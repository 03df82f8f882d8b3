r"""Operator 3: chat formatting of maximal conversations (cumulative-snapshot collapse).

A chat that is logged after every turn leaves snapshots, each the beginning of the next. Each turn's prefix has a rolling
hash: the exclusive or of hashes of (position, role, text) up to the turn. A conversation is dropped if its whole hash is the
hash of a proper prefix of another one (an anti-join on length and hash); of equal conversations the smallest
``conv_id`` stays. What remains is rendered.

Because the rolling hash is an exclusive or, it is built in two levels: within blocks of ``BLOCK`` turn numbers, and
over the blocks of a conversation. So a conversation that holds a third of all rows is spread over tasks, and so
is its rendering, in parts of ``PART`` turns. Common prefixes, such as one first turn of very many chats, are reduced
to one row each before the anti-join.

Defined results: turns are ordered by ``turn`` (null first), then role and text (null first); repeated rows count once; rows
without a ``conv_id`` belong to no conversation and are left out. A null role is rendered as ``unknown``, a null text as an empty
one; both differ from any value when turns are compared. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import materialize

#: Turn numbers of a block, and turns of a rendered part.
BLOCK, PART = 256, 512


def _hash(salt: int):
    return F.xxhash64(F.lit(salt), F.col("pos"), F.col("role").isNull(), F.col("role"), F.lit(salt), F.col("text").isNull(), F.col("text"))


def rolling_hashes(df: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text, p1, p2``: the turns with positions from 1 and 128 bits of hash of what is up to them."""
    turns = df.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).where("conv_id is not null").distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    turns = turns.withColumn("at", F.row_number().over(inside)).join(
        counts, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("k"))).select(
        "conv_id", "block", (F.col("skip") + F.col("at")).alias("pos"), "role", "text")
    turns = materialize(turns.withColumn("h1", _hash(1)).withColumn("h2", _hash(2)), "turns")
    sums = turns.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("k"),
                       *[F.coalesce(F.bit_xor(x).over(before.partitionBy("conv_id")), F.lit(0)).alias(x) for x in ("x1", "x2")])
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("y1", F.bit_xor("h1").over(upto)).withColumn("y2", F.bit_xor("h2").over(upto))
    return turns.join(sums, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("k"))).select(
        "conv_id", "pos", "role", "text", F.col("x1").bitwiseXOR(F.col("y1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that prefix no longer one (of equal ones the smallest id)."""
    last = materialize(turns.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("end")), "conversations")
    whole = last.groupBy("end.pos", "end.p1", "end.p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = turns.join(last.select("conv_id", F.col("end.pos").alias("n")), "conv_id").where("pos < n").select("pos", "p1", "p2").distinct()
    return whole.join(longer, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, start: str = "<|", middle: str = "|>\n", end: str = "\n", part: int = PART) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text``: kept conversations in parts of ``part`` turns, from part 0."""
    piece = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    rows = turns.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.floor((F.col("pos") - 1) / part).alias("part"),
                                              F.struct("pos", piece.alias("piece")).alias("turn"))
    return rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", "part", "n_turns", "n_copies", F.array_join("turns.piece", "").alias("text"))


def chat(df: DataFrame, **options) -> DataFrame:
    """Rendered maximal conversations of ``df`` (``conv_id, turn, role, text``)."""
    turns = materialize(rolling_hashes(df), "rolling-hashes")
    return render(turns, materialize(maximal(turns), "maximal-conversations"), **options)


#: The same in DuckDB SQL, over the table ``conversations`` (for conversations of one part).
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns,
             string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS rendered
      FROM p GROUP BY conv_id),
w AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY turns, n)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n AS n_turns, n_copies, rendered AS text
FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > w.n AND c.turns[1:w.n] = w.turns)
"""
