"""Chat formatting with cumulative-snapshot collapse; DataFrame operations only.

A conversation logged after every turn leaves snapshots that are prefixes of the final one. Each turn gets a 128-bit
hash of its position, role and text; the exclusive or of the first k of them is the rolling hash of the k-turn prefix.
Conversations whose whole hash is a proper prefix of another one are removed by an anti-join, equal ones keep the
smallest conv_id, and what stays is rendered. Equal hashes of equal length are taken as equal prefixes; texts are not
compared again (two given prefixes that differ agree with a probability of about 2**-128, unless made to).

All turns are dealt into ranges of (conv_id, turn, role, text) of about one size, so a conversation that holds many of
them spans many ranges. Turns are numbered in two levels, inside ranges and over them, and rendered ``PART`` turns a row,
so no step gathers a whole conversation; prefixes and heads are made distinct before they are shuffled.

Defined cases: rows equal in conv_id, turn, role and text count once. Order: turn (null last), then role, then text
(nulls first). A null role renders as "user", a null text as nothing; nulls differ from empty values when conversations
are compared. Marks of turns inside roles and texts are rendered as ``< |im_...``, so that a text cannot begin a turn. A very
long text is rendered whole. Rows with a null conv_id form one conversation. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

PART = 64
BEGIN = 64  # characters of a text that tell its range, as the bounds are drawn on the driver


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, run, turn, role, text, pos, n): positions from 1 and the number of turns."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    begin = [F.left(c, F.lit(BEGIN)).asc_nulls_first() for c in ("role", "text")]
    rows = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), *begin)
    rows = materialize(rows.withColumn("run", F.spark_partition_id()), "ranges")  # range bounds are drawn anew by each run of the plan
    sizes = rows.groupBy("conv_id", "run").agg(F.count("*").alias("m"))
    runs = Window.partitionBy("conv_id").orderBy("run")
    before = F.coalesce(F.sum("m").over(runs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("conv_id", "run", before.alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n"))
    sizes = sizes.withColumnsRenamed({"conv_id": "c", "run": "r"})
    inner = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(*_order()))
    placed = rows.withColumn("inner", inner).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return placed.select("conv_id", "run", "turn", "role", "text", (F.col("before") + F.col("inner")).alias("pos"), "n")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, a, b): two 64-bit rolling hashes of each prefix."""
    told = [F.col("pos"), F.coalesce(F.concat(F.lit("r"), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))]
    rows = turns.select("conv_id", "run", "pos", "n", F.xxhash64(F.lit(1), *told).alias("a"), F.xxhash64(F.lit(2), *told).alias("b"))
    runs = rows.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), *(F.coalesce(F.bit_xor(x).over(earlier), zero).alias(f"{x}0") for x in "ab"))
    inside = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({x: F.bit_xor(x).over(inside) for x in "ab"})
    rows = rows.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return rows.select("conv_id", "pos", "n", *(F.col(x).bitwiseXOR(F.col(f"{x}0")).alias(x) for x in "ab"))


def rendered_turn() -> Column:
    plain = lambda c, null: F.replace(F.coalesce(c, F.lit(null)), F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit("<|im_start|>"), plain("role", "user"), F.lit("\n"), plain("text", ""), F.lit("<|im_end|>\n"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of the conversations that no other one continues.

    ``part`` counts rows of ``PART`` turns each from 0; ``copies`` is how many equal conversations were logged.
    """
    with scratch(conversations.sparkSession):
        turns = materialize(numbered_turns(conversations), "turns", keep=True)
    hashes = materialize(prefix_hashes(turns), "prefixes")
    proper = hashes.where("pos < n").select("pos", "a", "b").distinct()
    heads = hashes.where("pos = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("keep"), F.count("*").alias("copies"))
    same = (heads["n"] == proper["pos"]) & (heads["a"] == proper["a"]) & (heads["b"] == proper["b"])
    kept = heads.join(proper, same, "left_anti").select("keep", "copies")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("keep")))
    part = F.floor((F.col("pos") - 1) / PART).alias("part")
    gathered = rows.groupBy("conv_id", part).agg(
        F.max("n").alias("n_turns"),
        F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("pos", rendered_turn().alias("shown")))).alias("turns"),
    )
    return gathered.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("turns.shown"), "").alias("rendered"))
