"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation that combines on the map side, written to the shared folder, and an
equi-join of two such tables, which adaptive execution can split, so a node with very many links burdens
no single task; edges go to the shared folder after each round. Rounds grow with the logarithm of the longest chain. Nothing but two counters reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: hang each node's larger neighbours on its smallest neighbour.
    Small: hang each node and its smaller neighbours on the smallest of them."""
    if large:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionByName(turned)
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, itself included. Nodes
    without a link to another node have no row. Null ends, loops and repeated edges are ignored; any
    orderable node type will do; no edges give no rows."""
    with scratch(edges.sparkSession) as keep:
        now = keep(_settled(edges, a, b))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each node that is not its component's smallest, with the smallest."""
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
        .where(F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        half = stage(_star(now, True), "half")
        after = stage(_star(half, False), "stars")
        new = _mark(after)
        remove(half, now)
        now = after
        if new == mark:
            break
        mark = new
    return now
