"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join: a node with very many links is pre-aggregated before the shuffle, and
its links are dealt over many tasks for the join. Links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_spread, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour larger than ``u`` is linked to the smallest of ``u`` and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = materialize(both.where("v > u"), "upward")
    return join_spread(up, least, "u", hot_keys(up, "u"), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``u`` and its neighbours smaller than ``u`` are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``links`` (u, v) -> (u, component) for every node that is not the smallest of its component.

    Self links and null ends are ignored; repeated links count once; an empty table gives an empty table.
    """
    down = links.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    at = materialize(down.distinct(), "links")
    for _ in range(max_rounds):
        if _settled(at):
            return at.select("u", F.col("v").alias("component"))
        at = materialize(_small_star(_large_star(at)), "stars")
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link upwards or is a root: no node has two, or one and links to it."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
    return bad.isEmpty()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (u, component) after further links (u, v): components are contracted to their smallest node first."""
    ends = links
    for end in ("u", "v"):
        found = labels.select(F.col("u").alias(end), F.col("component").alias("to"))
        ends = ends.join(found, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    moved = connected_components(ends)
    to = moved.select(F.col("u").alias("component"), F.col("component").alias("to"))
    kept = labels.join(to, "component", "left").select("u", F.coalesce("to", "component").alias("component"))
    return materialize(kept.unionByName(moved).dropDuplicates(["u"]), "labels")
