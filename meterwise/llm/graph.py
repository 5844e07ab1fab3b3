"""Connected components of an edge table by alternating stars.

Each round hooks every node to the smallest node of its neighbourhood, first
among the larger neighbours, then among the smaller ones, until the edges form
stars around the smallest node of each component. A round aggregates minima
(partial aggregation absorbs hubs) and joins them back (a sort-merge join,
whose hot keys adaptive execution splits). No window or list gathers a node's
neighbours, and every round ends in a written table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import cut


class Forest:
    """Spanning forest of the links of one block, a row of links at a time."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.edges += [(i, int(j)) for j in others[first[new]]]
            self.label[np.isin(self.label, labels[new])] = self.label[i]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has two comparable columns, in either direction; repeated edges
    and loops change nothing, and an edge with a null end is no edge. An empty
    input gives an empty result.
    """
    a, b = edges.columns[:2]
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))
    return (both.join(low, F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    rest = (e.join(low, F.col("u") == F.col("c")).where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return rest.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
