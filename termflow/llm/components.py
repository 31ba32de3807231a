"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.llm.common import cut, drop_cut

#: Edges of a node from which its part of a join is dealt out, and share of all edges from which at least; so hubs are few.
HUB, HUB_SHARE = 1024, 100_000
#: Edges that the driver joins by itself, 16 bytes each.
FEW = 1 << 18


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component (the least node reachable) of every node of `edges` (a, b), by alternating star contraction.

    Each round links every node to the least node it has seen: larger neighbours first, then smaller
    ones. The number of edges never grows, a round is two aggregations with map-side combine and two
    joins, and each round's edges are written to the shared folder. It ends when a round changes nothing,
    after a number of rounds that grows with the logarithm of the longest chain, or when no more than `few`
    edges are left: those the driver joins. Nulls have no edges.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _state(now)
    while seen[0] > few:
        before, now = now, cut(_smaller(_larger(now, seen[0])))
        drop_cut(before)
        if (state := _state(now)) == seen:
            break
        seen = state
    else:
        out = cut(_joined(now))
        drop_cut(now)
        return out
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """`components` of a few edges, on the driver: roots move to the least root next to them until all edges are inside."""
    got = edges.toArrow()
    kind = got.schema.field("a").type
    nodes, at = np.unique(np.concatenate([got["a"].to_numpy(), got["b"].to_numpy()]), return_inverse=True)
    a, b = at[: got.num_rows], at[got.num_rows :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    out = pa.table({"node": pa.array(nodes, kind), "component": pa.array(nodes[label], kind)})
    spark, schema = edges.sparkSession, edges.withColumnsRenamed({"a": "node", "b": "component"}).schema
    return spark.createDataFrame(out, schema) if len(nodes) else spark.createDataFrame([], schema)


def _state(edges: DataFrame) -> tuple:
    """Count and a hash sum of the edges: equal when nothing changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _larger(edges: DataFrame, size: int) -> DataFrame:
    """Larger neighbours of each node go to the least node it knows, over edges (a > b), of which there are `size`. A hub's edges are dealt over several keys, and so is its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    most = max(HUB, size // HUB_SHARE)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), F.ceil(F.col("n") / most).alias("parts"))
    hubs = least.filter("parts > 1").select(F.col("u").alias("h"), "parts")  # 2 * HUB_SHARE rows at most
    dealt = both.join(F.broadcast(hubs), F.col("a") == F.col("h"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part"))
    every = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    df = dealt.join(every, (F.col("a") == F.col("u")) & (F.col("part") == F.col("p")))
    return df.filter(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them, over edges (a > b); after `_larger` a node has few of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    df = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return df.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
