"""Connected components of a link table, by alternating stars. No node's links meet in one row or task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.scratch import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the least node around it."""
    # One shuffle by node serves the distinct links, the least neighbours and their join.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a").dropDuplicates(["a", "b"])
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a < b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its neighbours below are linked with the least of them."""
    links = links.repartition("b").dropDuplicates(["a", "b"])
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    # The link with the least one stays; the other neighbours move.
    return links.join(least, "b").select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("m").alias("a"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    `links` has two columns a and b of whole numbers. Repeated links, links in both directions
    and links of a node with itself are allowed; nulls are left out. No links give an empty table.
    """
    now, seen = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
        now = staged(_small_star(_large_star(now)), "links")
    # Stars are left: a node is the centre of one, or has one link.
    named = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return staged(named.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct(), "components")


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links. Only links between two components are walked, as links of their names."""
    of = {side: component.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in ("a", "b")}
    ends = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    top = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    top = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = component.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = top.select(F.col("component").alias("node"), F.col("top").alias("component")).join(component, "node", "left_anti")
    return staged(known.unionByName(new), "components")
