"""Connected components by alternating large-star and small-star steps (public algorithm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import discard, split_join, written


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's neighbours beside the least of the node and its neighbours: (u, v, m); hubs can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("least_v"))
    return split_join(edges, least, "u").select("u", "v", F.least("u", "least_v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    s = _stars(edges)
    up = s.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return up.union(s.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst longs); component: the least node.

    Every round is a pair of aggregations and joins whose result is written to the shared folder,
    so that no plan grows and lost executors cost one round. Hot nodes are aggregated map-side, and
    adaptive execution may split the joins. Nulls and self links are
    ignored; no edges give no rows.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = written(e.where("src is not null and dst is not null and u <> v").distinct(), "edges")
    mark = None
    while True:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            break
        mark = (row.n, row.h)
        before, e = e, written(_small_star(_large_star(e)), "edges")
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
