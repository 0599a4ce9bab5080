"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .exact import lookup_join


def _with_least(edges: DataFrame, total: int, use: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """use(edges (u, v) with m, the least v of each u), written. Hubs are joined by broadcast, see exact.py."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("group_size")).persist()
    out = materialize(use(lookup_join(edges, least, ["u"], total)).distinct(), tag)
    least.unpersist()
    return out


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total, lambda x: x.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")), "large-star")


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. All edges point down (u > v)."""
    others = lambda x: x.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _with_least(edges, total, lambda x: others(x).unionByName(x.select("u", F.col("m").alias("v"))), "small-star")


def components(links: DataFrame) -> DataFrame:
    """From undirected links (a, b): rows (id, component), component the least id reachable. Nodes that are least of their
    component, or have no link, have no row."""
    down = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(down, "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(edges)
    while before.n:
        after_large = large_star(edges, before.n)
        after_small = small_star(after_large, before.n)
        discard(edges)
        discard(after_large)
        edges, after = after_small, mark(after_small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
