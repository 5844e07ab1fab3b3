"""Exact cosine near-duplicates of vectors by dual traversal of cover trees.

Equal vectors of a label become one weighted representative. Representatives
of large labels are dealt to cells around a bounded number of broadcast
centres, cells are cut into blocks of bounded size, and pairs of cells whose
covering radii keep them further apart than the threshold are dropped. Each
remaining pair of blocks is one task: it builds a cover tree for each block
(nested levels of centres, radii halving from one level to the next) and walks
both trees together, dropping node pairs by the same bound and counting node
pairs that lie wholly within the threshold without looking inside.

Tasks return link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.llm.common import cut
from meterwise.llm.graph import Forest, components

BLOCK = 2048        # representatives in a block, on average
MAX_CENTRES = 1024  # centres broadcast over all labels together
LEAF = 32           # nodes of so few points are not split
DENSE = 4096        # point pairs that are simply multiplied
KEPT_SHARE = 0.5    # if bounds keep more of a node pair than this, it is multiplied as a whole
SLACK = 1e-6        # on bounds, as distances near zero are only good to 1e-8: rounding never decides a link


class CoverTree:
    """Nested cover of unit vectors; a node's points are order[low:high]."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.low, self.high, self.radius, self.children = [], [], [], [], []
        far = _distance(points, points[0])
        self._node(0, 0, len(points), far, float(far.max()))

    def _node(self, centre: int, low: int, high: int, far: np.ndarray, cover: float) -> int:
        """``far``: distances from the centre to the node's points, in order; ``cover`` halves by level."""
        me, todo = len(self.centre), []
        for column, value in ((self.centre, centre), (self.low, low), (self.high, high),
                              (self.radius, float(far.max())), (self.children, [])):
            column.append(value)
        if high - low <= LEAF or self.radius[me] <= SLACK:
            return me
        while cover >= self.radius[me]:  # levels without a new centre
            cover /= 2
        rest, dist, own, parts = self.order[low:high].copy(), far, centre, []
        while True:
            near = dist <= cover
            parts.append((own, rest[near], dist[near]))
            rest = rest[~near]
            if not len(rest):
                break
            own = int(rest[0])
            dist = _distance(self.points[rest], self.points[own])
            dist[0] = 0.0
        at = low
        for own, members, dist in parts:
            self.order[at:at + len(members)] = members
            todo.append((own, at, at + len(members), dist))
            at += len(members)
        self.children[me] = [self._node(*x, cover) for x in todo]
        return me

    def freeze(self) -> CoverTree:
        self.rows = self.points[self.order]
        self.centres = self.points[self.centre]
        self.radius, self.low, self.high = np.array(self.radius), np.array(self.low), np.array(self.high)
        return self


def _distance(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ one)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision, scaled first so squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def dual_links(a: np.ndarray, wa: np.ndarray, b: np.ndarray | None, wb: np.ndarray | None,
               threshold: float) -> tuple[np.ndarray, Forest]:
    """Weighted link counts of a's rows, then b's, and the forest of links; b None: links within a.

    Within one block a row's link to itself counts its weight; the caller takes
    it off.
    """
    reach = math.sqrt(2.0 - 2.0 * threshold)
    left = CoverTree(a).freeze()
    right = left if b is None else CoverTree(b).freeze()
    base = 0 if b is None else len(a)
    la, lb = left.order, right.order + base
    wl, wr = wa[left.order], (wa if b is None else wb)[right.order]
    counts, forest = np.zeros(base + len(right.points), np.int64), Forest(base + len(right.points))

    def found(i0: int, i1: int, j0: int, j1: int, hits: np.ndarray | None) -> None:
        if hits is None:
            counts[la[i0:i1]] += wr[j0:j1].sum()
            if b is not None:
                counts[lb[j0:j1]] += wl[i0:i1].sum()
            forest.link(la[i0], lb[j0:j1])
            forest.link(lb[j0], la[i0:i1])
            return
        counts[la[i0:i1]] += hits @ wr[j0:j1]
        if b is not None:
            counts[lb[j0:j1]] += wl[i0:i1] @ hits
        for i in np.flatnonzero(hits.any(axis=1)):
            forest.link(la[i0 + i], lb[j0:j1][hits[i]])

    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        i0, i1, j0, j1 = left.low[x], left.high[x], right.low[y], right.high[y]
        xs, ys = left.children[x] or [x], right.children[y] or [y]
        keep = None
        if (i1 - i0) * (j1 - j0) > DENSE and (xs != [x] or ys != [y]):
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (left.centres[xs] @ right.centres[ys].T)))
            reached = left.radius[xs][:, None] + right.radius[ys][None, :]
            keep = gap - reached <= reach + SLACK
            inside = gap + reached <= reach - SLACK
            sizes = (left.high[xs] - left.low[xs])[:, None] * (right.high[ys] - right.low[ys])[None, :]
            if (sizes * (keep & ~inside)).sum() > KEPT_SHARE * (i1 - i0) * (j1 - j0):
                keep = None
        if keep is None:
            for s in range(i0, i1, BLOCK):
                e = min(i1, s + BLOCK)
                hits = left.rows[s:e] @ right.rows[j0:j1].T >= threshold
                if hits.any():
                    found(s, e, j0, j1, hits)
            continue
        for p, q in zip(*np.nonzero(keep)):
            if inside[p, q]:
                found(left.low[xs[p]], left.high[xs[p]], right.low[ys[q]], right.high[ys[q]], None)
            else:
                stack.append((xs[p], ys[q]))
    return counts, forest


def _block_pair(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[2], key[3]
        rows = rows.sort_values(["block", "id"])
        ids, weights = rows["id"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
        vectors = unit(np.stack([np.asarray(v, float) for v in rows["v"]]))
        n = int((rows["block"] == lo).sum())
        if lo == hi:
            counts, forest = dual_links(vectors, weights, None, None, threshold)
            counts -= weights
        elif n in (0, len(ids)):
            return pd.DataFrame({"id": ids[:0], "links": ids[:0], "root": ids[:0]})
        else:
            counts, forest = dual_links(vectors[:n], weights[:n], vectors[n:], weights[n:], threshold)
        linked = np.flatnonzero(counts > 0)
        least = pd.Series(ids).groupby(forest.label).transform("min").to_numpy()
        return pd.DataFrame({"id": ids[linked], "links": counts[linked], "root": least[linked]})
    return run


def _nearest(centres: dict) -> object:
    """Assigns rows to the nearest centre of their (label, dim): (cell, dist)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            cell, dist = np.zeros(len(keys), np.int32), np.full(len(keys), 2.0)
            by_key = defaultdict(list)
            for i, k in enumerate(keys):
                if k in known:
                    by_key[k].append(i)
            for k, at in by_key.items():
                v = unit(np.array(batch.column("v").take(pa.array(at)).to_pylist(), float))
                cos = v @ known[k].T
                cell[at] = cos.argmax(axis=1)
                dist[at] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)],
                                             names=[*batch.schema.names, "cell", "dist"])
    return run


def _partners(spark, reps: DataFrame, sizes: DataFrame, total: int):
    """(reps with cell and block, table of a cell's partner cells) under the covering-radius bound."""
    share = max(BLOCK, -(-total // MAX_CENTRES))
    large = [(r["label"], r["dim"], r["n"]) for r in sizes.where(F.col("n") >= 2 * share).collect()]  # <= MAX_CENTRES / 2
    centres = {}
    if large:
        wanted = spark.createDataFrame([(x, d, n, n // share) for x, d, n in large],
                                       f"label {reps.schema['label'].dataType.simpleString()}, dim int, n long, k long")
        drawn = (reps.join(F.broadcast(wanted), ["label", "dim"])
                 .where(F.pmod(F.xxhash64("id"), F.col("n")) < 4 * F.col("k"))
                 .withColumn("r", F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("id"), "id")))
                 .where("r <= k").select("label", "dim", "v").collect())
        lists = defaultdict(list)
        for r in drawn:
            lists[r["label"], r["dim"]].append(r["v"])
        centres = {k: unit(np.array(v, float)) for k, v in lists.items()}
    known = spark.sparkContext.broadcast(centres)
    celled = cut(reps.select("id", "label", "dim", "v", "weight").mapInArrow(
        _nearest(known), f"id bigint, label {reps.schema['label'].dataType.simpleString()}, dim int, "
                         "v array<double>, weight bigint, cell int, dist double"))
    cells = cut(celled.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
                .withColumn("subs", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")))
    alone = cells.select("label", "dim", "cell", F.col("cell").alias("partner"), F.col("subs").alias("partner_subs"))
    return celled, cells, alone, centres


def near_pairs(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
               label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``.

    Two rows link if their labels are equal and not null and the cosine of
    their vectors in double precision is at least ``threshold``. A vector that
    is null, empty, zero or holds a null or non-finite component, or whose
    length differs from the other's, links with nothing: 0 links, its own
    component. component_id is the smallest id reachable, itself included;
    kept is id = component_id. Rows repeated under one id count as rows that
    link; ids are integers and not null. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = cut(plain.withColumn("v", F.when(usable, F.col("v")))
               .withColumn("dim", F.size("v").cast("int")))
    good = rows.where(F.col("v").isNotNull())
    reps = cut(good.groupBy("label", "dim", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    celled, cells, alone, centres = _partners(spark, reps, sizes, reps.count())
    partners = alone
    if centres:
        names = spark.createDataFrame([(k[0], k[1]) for k in centres],
                                      f"label {reps.schema['label'].dataType.simpleString()}, dim int")
        stats = defaultdict(list)
        for r in cells.join(F.broadcast(names), ["label", "dim"], "left_semi").collect():  # <= MAX_CENTRES
            stats[r["label"], r["dim"]].append((r["cell"], r["radius"], r["subs"]))
        met = []
        reach = math.sqrt(2.0 - 2.0 * threshold)
        for k, found in stats.items():
            at, radius, subs = (np.array(x) for x in zip(*found))
            own = centres[k][at]
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (own @ own.T)))
            near = gap - radius[:, None] - radius[None, :] <= reach + SLACK
            np.fill_diagonal(near, False)
            met += [(*k, int(at[i]), int(at[j]), int(subs[j])) for i, j in zip(*np.nonzero(near))]
        if met:
            partners = alone.union(spark.createDataFrame(met, alone.schema))
    block = lambda cell, sub: cell.cast("long") * F.lit(1 << 32) + sub
    own = celled.join(cells.select("label", "dim", "cell", "subs"), ["label", "dim", "cell"])
    tasks = (own.withColumn("block", block(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("subs"))))
             .join(partners, ["label", "dim", "cell"])
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("partner_subs") - 1)))
             .withColumn("other", block(F.col("partner"), F.col("sub")))
             .select("label", "dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "block", "id", "weight", "v"))
    links = cut(tasks.groupBy("label", "dim", "lo", "hi").applyInPandas(
        _block_pair(threshold), "id bigint, links bigint, root bigint"))
    counts = links.groupBy(F.col("id").alias("c_id")).agg(F.sum("links").alias("links"))
    found = components(links.select("id", "root"))
    # A representative counts its equals as well: weight - 1 links to them.
    told = (reps.join(counts, F.col("id") == F.col("c_id"), "left")
            .join(found, F.col("id") == F.col("node"), "left")
            .select(F.col("label").alias("l"), F.col("v").alias("rv"),
                    (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))
    joined = rows.join(told, (F.col("label") == F.col("l")) & (F.col("v") == F.col("rv")), "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "id").alias("component_id"),
                         (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
