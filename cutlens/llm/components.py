"""Connected components of a link table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.session import cut_lineage


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Large and small stars in turn: every node hands its neighbours to the smallest one, until each
    component is one star. Links with a null end are ignored; self links and repeated links are allowed.
    Each round is two aggregates and two joins; nothing but one checksum a round comes to the driver.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    links = cut_lineage(links.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        around = edges.select(F.explode(both).alias("e")).select("e.*")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        edges = cut_lineage(small)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    lone = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).unionByName(lone)
    return found.groupBy("node").agg(F.min("component").alias("component"))
