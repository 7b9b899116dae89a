"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import discard, write_once

#: Rounds after which an unfinished run is an error; each round at least halves the longest chains.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to the least of them: the greater ones (large) or the smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of any orderable type to (node, component), the component named by its least node.

    Null ends and loops are ignored; a node without an edge isn't listed. Minima are taken with partial
    aggregation and given back by joins, so that a node with very many edges is never collected anywhere.
    """
    now = write_once(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = print_of(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        now, before = write_once(_star(_star(now, True), False), "edges"), now
        discard(before)
        new = print_of(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
