"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, stored

#: Links that a task contracts at a time.
HELD = 1_000_000


def _forest(batches):
    """Links (a, b) as links from nodes to the least node that the same links connect them with: fewer links, the same components.
    Each task does this for its own links, HELD at a time, without moving rows."""
    a, b = [], []

    def out():
        x, y = np.concatenate(a), np.concatenate(b)
        nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = flat[: len(x)], flat[len(x) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while (root[root] != root).any():
                root = root[root]
            if (root[x] == root[y]).all():
                break
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    held = 0
    for batch in batches:
        if batch.num_rows:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= HELD:
                yield out()
                held = 0
    if held:
        yield out()


def _contracted(links: DataFrame) -> DataFrame:
    return stored(links.select("a", "b").mapInArrow(_forest, "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of edges (a, b bigint). Nodes whose only link is to
    themselves don't appear; repeated links count once; an empty table gives an empty table.

    Each step is written to the shared folder. A node's least neighbour is a sum-like aggregate, combined before rows move;
    the joins that bring it to the node's links have plain shuffles of stored tables on both sides, so that Spark
    splits the links of a node that has very many. Links never come to the driver, which only learns whether a round is the last."""
    now = _contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"))
    while True:
        around = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(around.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "least")
        # only stars are left if each node has larger neighbours alone, or one neighbour
        if not least.filter("low < u and low < high").limit(1).count():
            discard(now)
            out = least.select(F.col("u").alias("node"), F.least("low", "u").alias("component"))
            out._loomwork_path = least._loomwork_path
            return out
        # large star: larger neighbours go to the least one
        met = around.hint("merge").join(least.select("u", F.least("low", "u").alias("m")), "u")
        large = _contracted(met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        discard(now, least)
        # small star: smaller neighbours and the node itself go to the least one
        least = stored(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        met = large.select(F.col("a").alias("u"), F.col("b").alias("v")).hint("merge").join(least, "u").filter("v <> m")
        now = _contracted(met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        discard(large, least)
