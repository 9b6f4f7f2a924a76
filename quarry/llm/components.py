"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


#: Nodes of more edges than the rest that are looked up by broadcast at most.
HUBS = 50_000
#: Edges a node has at least to be one of them.
LEAST_HUB = 64


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` with the ``m`` that ``least`` (``a``, ``m``, ``n``) has for ``a``.

    A node of more than ``edges / HUBS`` edges is a hub, so there are at most
    ``HUBS`` hubs, whatever the input: 16 bytes each, which are broadcast, and
    a hub's edges stay where they lie.  The others meet by shuffle, no key of
    theirs above that many rows.
    """
    limit = max(LEAST_HUB, edges // HUBS)
    hubs = least.where(F.col("n") > limit).select("a", F.col("m").alias("hub"))
    others = least.select("a", "m")
    if hubs.isEmpty():
        return rows.join(others, "a")
    marked = rows.join(F.broadcast(hubs), "a", "left")
    near = marked.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m"))
    return near.unionByName(marked.where("hub IS NULL").select("a", "b").join(others, "a").select("a", "b", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs in, ``(node, root)`` out, for every node that has
    an edge to another; ``root`` is the smallest node reachable.

    Each round points all larger neighbours of a node at its smallest one,
    then every node's smaller neighbours likewise.  Rounds grow with the
    logarithm of the longest chain; every round is a written table, so a lost
    executor costs one round at most.  Only two numbers reach the driver.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = _with_least(both, least, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = staged(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = _with_least(large, low, before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for gone in (old, least, low):
            release(gone)
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
