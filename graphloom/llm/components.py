"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, look_up, saved


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours in v. Nodes with very many neighbours are looked up apart."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return look_up(edges, "u", least, "degree", how="inner")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b), of any type that has an order; component is the least node that links reach.

    Alternates large-star and small-star steps: each node hands its larger neighbours, then its smaller ones, to the least node it sees, until
    nothing changes. Links stay as many as they were at most."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large")
        with_m = _with_least(large)
        small = with_m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(with_m.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, edges = edges, saved(small, "small")
        forget(before, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
