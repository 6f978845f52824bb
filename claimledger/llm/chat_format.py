"""Chat formatting: drop logged conversations that are prefixes of longer ones, render the rest.

Only hashes of roles and texts travel until it is known which conversations stay.  Every turn gets the rolling hash of the turns up to it: two running XORs of 64-bit hashes of
(position, hashes of role and text), so equal prefixes have equal pairs.  Running values come from windows over
blocks of ``block`` turns and over block totals, so a conversation of any length is spread over
tasks.  A conversation goes if its whole hash is a proper prefix hash of another one; of equal
conversations the smallest id stays.  Rendering is by parts of ``block`` turns, in order.

Positions are ranks of ``turn``; turns that tie are ordered by role and text, and exact repeats of
a turn count once.  A null role or text is rendered as empty but differs from an empty one in the
hash.  Rows without conv_id or turn are left out.  Extra columns do not matter, an empty table gives an
empty result, and texts of any length are hashed and rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm.common import read_table, store, work_dir

#: Rendered form of a turn.
TURN_START, TURN_END = "<|", "<|end|>\n"


def turn_hash(salt: int) -> Column:
    """Hash of a turn's role and text; tags keep a null apart from an empty text."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def light_turns(turns: DataFrame, folder: str) -> DataFrame:
    """conv_id, turn, h1, h2, tie: distinct turns by two hashes of role and text, and the rank among turns of one number.

    Texts stay where they are, but for those of turns that share a number: their order decides the rank.
    The shared numbers are stored first, so Spark knows their size and moves no texts to few or none of them.
    """
    all_ = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", turn_hash(1).alias("h1"), turn_hash(2).alias("h2"))
    light = store(all_.select("conv_id", "turn", "h1", "h2").distinct(), folder, "distinct")
    several = store(light.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", "turn"), folder, "several")
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranked = all_.join(several, ["conv_id", "turn"], "left_semi").distinct().select("conv_id", "turn", "h1", "h2", F.row_number().over(order).alias("tie"))
    return light.join(ranked, ["conv_id", "turn", "h1", "h2"], "left").withColumn("tie", F.coalesce("tie", F.lit(1)))


def _positions(turns: DataFrame, block: int) -> DataFrame:
    """Adds ``pos``, the 0-based rank of the turn in its conversation, without one task per conversation.

    ``turn`` values fall into ranges of ``block``; ranks inside a range and the sizes of the earlier
    ranges add up to the position.
    """
    t = turns.withColumn("_range", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn", "tie")
    t = t.withColumn("_rank", F.row_number().over(inside) - 1)
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", F.floor(F.col("turn") / block).alias("_range")).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return t.join(sizes, ["conv_id", "_range"]).withColumn("pos", F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def prefix_hashes(turns: DataFrame, block: int = 1000) -> DataFrame:
    """conv_id, turn, h1, h2, _range, pos and the rolling hashes p1, p2 of the turns up to this one; ``turns`` as ``light_turns`` gives them.

    The position is hashed too, so the XOR depends on the order.
    """
    placed = lambda salt: F.xxhash64(F.lit(salt), F.col("pos"), F.col("h1"), F.col("h2"))
    t = _positions(turns, block).withColumn("_a", placed(3)).withColumn("_b", placed(4))
    run = Window.partitionBy("conv_id", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("conv_id", "_range").agg(F.bit_xor("_a").alias("_x"), F.bit_xor("_b").alias("_y"))
    totals = totals.select("conv_id", "_range", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("_x", "_y")])
    t = t.withColumn("_ra", F.bit_xor("_a").over(run)).withColumn("_rb", F.bit_xor("_b").over(run))
    t = t.join(totals, ["conv_id", "_range"])
    return t.select("conv_id", "turn", "h1", "h2", "_range", "pos", F.col("_ra").bitwiseXOR(F.col("_x")).alias("p1"), F.col("_rb").bitwiseXOR(F.col("_y")).alias("p2"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one extends or (with a smaller id) equals."""
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("e"))
    ends = ends.select("conv_id", F.col("e.pos").alias("pos"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"))
    whole = ends.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    last = ends.select("conv_id", F.col("pos").alias("_last"))
    inner = hashes.select("conv_id", "pos", "p1", "p2").join(last, "conv_id").where("pos < _last").select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", (F.col("pos") + 1).alias("n_turns"), "n_logged")


def render(turns: DataFrame, places: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation and part: conv_id, part, n_turns, n_logged, text.

    ``places`` are the turns' positions; the texts of kept conversations meet them and then their part.
    """
    line = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END))
    key = ["conv_id", "turn", "h1", "h2"]
    lines = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), turn_hash(1).alias("h1"), turn_hash(2).alias("h2"), line.alias("line"))
    wanted = places.select(*key, "_range", "pos").join(kept, "conv_id")
    parts = wanted.join(lines, key).groupBy("conv_id", "n_turns", "n_logged", "_range").agg(F.sort_array(F.collect_set(F.struct("pos", "line"))).alias("l"))  # repeats of a turn count once
    number = Window.partitionBy("conv_id").orderBy("_range")
    return parts.select("conv_id", (F.row_number().over(number) - 1).alias("part"), "n_turns", "n_logged", F.array_join(F.col("l.line"), "").alias("text"))


def format_conversations(turns: DataFrame, block: int = 1000) -> DataFrame:
    folder = work_dir(turns.sparkSession)
    places = store(prefix_hashes(store(light_turns(turns, folder), folder, "turns"), block), folder, "hashes")
    return render(turns, places, maximal_conversations(places))


def op4_chat_format(spark, sf_dir):
    return format_conversations(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {
    "op4_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'r': role, 't': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM c, unnest(range(1, n_turns)) AS u(k)),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM c GROUP BY turns)
SELECT c.conv_id, CAST(0 AS INTEGER) AS part, CAST(c.n_turns AS BIGINT) AS n_turns, w.n_logged, c.text
FROM w JOIN c ON c.conv_id = w.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
"""
}
