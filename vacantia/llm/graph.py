"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an edge: component is the smallest id that is reachable.

    Each half round points the larger (then the smaller) neighbours of a node to the least
    neighbour. The minima are aggregated before the shuffle and written, so that a hub's edges
    meet them in a join that adaptive execution can split. Self loops and nulls are left out.
    """
    edges = cut_lineage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        edges = cut_lineage(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct())
        least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
        moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"),
                                                              F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None
           ) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs (i, j) that span the graph over 0..n-1, and the least node that each node
    is joined with. A `label` of earlier calls (least nodes) is continued."""
    label = np.arange(n) if label is None else label
    chosen = []
    at = np.flatnonzero(label[i] != label[j])
    while len(at):
        a, b = label[i[at]], label[j[at]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        chosen.append(at[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        at = at[label[i[at]] != label[j[at]]]
    return (np.concatenate(chosen) if chosen else np.zeros(0, np.int64)), label
