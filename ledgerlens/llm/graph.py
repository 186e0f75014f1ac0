"""Connected components: of an edge table, and of the pairs that one task has found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import durable

TOGETHER = 1 << 17  # edges that a task holds at once


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(u, v)`; a component is its smallest node.

    Edges are written once. Parts of at most TOGETHER edges are each reduced to what connects their ends;
    edges that are one such part are done then, however many shuffle tasks there are. Others
    alternate two steps until nothing changes: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. No neighbour list is gathered anywhere: a hub is
    one row of minima joined to its edges, and joins split hot keys at run time. The number of
    rounds grows with the logarithm of the graph. Each round is written to the shared folder.
    Self-loops name lone nodes; null ends are ignored.
    """
    edges = durable(edges.select("u", "v").dropna(), "edges")
    lone = edges.filter("u = v").distinct()
    edges = edges.filter("u <> v")
    parts = max(1, -(-edges.count() // TOGETHER))
    edges = durable(_contracted(edges.coalesce(parts)), "edges")
    state = None
    while parts > 1:
        edges = durable(_small_star(_large_star(edges)), "edges")
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = lone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    alone = alone.join(found.select("node"), "node", "left_anti")
    return found.union(roots.union(alone).distinct())


def _contracted(edges: DataFrame) -> DataFrame:
    """What connects the edges of each partition, up to TOGETHER edges and a batch at a time."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for part in batches:
            held.append(part)
            count += len(part)
            if count > TOGETHER:
                yield _joined(held)
                held, count = [], 0
        if count:
            yield _joined(held)

    return edges.mapInPandas(contract, "u long, v long")


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    whole = pd.concat(parts)
    return connecting(whole["u"].to_numpy(), whole["v"].to_numpy())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = down.filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.filter("u <> v").union(kept).distinct()


def connecting(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """What connects the ends of the pairs (a, b): one row (u, v) for each but the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        np.minimum.at(least, before[x], low)
        np.minimum.at(least, before[y], low)
        least = least[least]
        if (least == before).all():
            break
    moved = least != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[least[moved]]})
