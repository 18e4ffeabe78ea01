"""Connected components of a graph given as a table of edges, by rounds of contraction.

In a round each task contracts runs of at most CHUNK edges to trees by itself: every node gets the node of its piece
with the least priority as its head. A node of several tasks has several heads; the least of them is the one it keeps, and
the others are joined to it, which makes the edges of the next round. So only heads that meet go on, a node reaches a shuffle
once a run at most (a hub of millions of edges is no hot key), and counts combine before each shuffle. Priorities are
hashes that differ by round, so any graph shrinks by a fraction a round, long chains too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, release
from .memory import tidy
from .words import mix

#: Edges that a task contracts at a time.
CHUNK = 1 << 18
#: A key with more than one in HOT of all rows is joined by broadcast; there are fewer than HOT of them, however many the rows.
HOT = 10_000


def _pieces(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of each node's component; nodes are numbers below n."""
    up = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, high, low)
        while True:  # straight to the top
            top = up[up]
            if (top == up).all():
                break
            up = top
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return up


def _heads(level: int):
    """(node, head, priority of the head) for the nodes of each run of edges."""

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes = np.unique(np.concatenate([a, b]))
        rank = mix(nodes.view(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        order = np.argsort(rank, kind="stable")
        nodes, rank = nodes[order], rank[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        by = np.sort(nodes)
        up = _pieces(at[np.searchsorted(by, a)], at[np.searchsorted(by, b)], len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up]), pa.array(rank[up])], names=["node", "head", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CHUNK:
                yield told(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield told(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _spread(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """left joined with right (one row a key), where a third of left may have one key."""
    n = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = n.where(F.col("_n") > total / HOT).select(key)
    hot = durable(hot.join(right, key, "left").withColumn("_hot", F.lit(True)), "hot")  # fewer than HOT rows
    near = left.join(F.broadcast(hot), key).drop("_hot")
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, how)
    near = near.dropna(subset=[c for c in right.columns if c != key]) if how == "inner" else near
    return near.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of an edge, from long columns a and b.

    Loops, repeated and null edges do no harm. Each round is written to the shared folder and is no larger than the last."""
    now, rounds = edges.where("a <> b").select("a", "b"), []
    while True:
        told = now.mapInArrow(tidy(_heads(len(rounds))), "node long, head long, p long")
        kept = told.groupBy("node").agg(F.min(F.struct("p", "head")).alias("least"), F.collect_set("head").alias("heads"))
        rounds.append(durable(kept.select("node", F.col("least.head").alias("head"), F.array_remove("heads", F.col("least.head")).alias("others")), "heads"))
        apart = rounds[-1].where(F.size("others") > 0)
        if apart.isEmpty():
            break
        now = apart.select(F.explode("others").alias("a"), F.col("head").alias("b"))
    # back from the last round to the first: a head's own head in later rounds is that of all its nodes
    out = rounds[-1].select("node", "head")
    for earlier in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("head"), F.col("head").alias("top"))
        out = durable(_spread(earlier.select("node", "head"), later, "head", "left").select("node", F.coalesce("top", "head").alias("head")), "heads")
    least = out.groupBy("head").agg(F.min("node").alias("component"))
    got = durable(_spread(out, least, "head", "inner").select("node", "component"), "components")
    for done in rounds:
        release(done)
    return got
