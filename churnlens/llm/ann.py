"""Approximate nearest neighbours (largest inner product) by vantage-point
trees.

In a shard, vectors get one more component so that all have the length of
the longest: the Euclidean distance to a query then falls as the inner
product grows, and the triangle inequality holds.  A tree node splits its
vectors at the median distance to a vantage point.  A side whose least
possible distance, times ``factor``, exceeds a query's k-th best distance is
left out: factor 1 is exact search, larger factors prune more.  All queries
of a block go down a tree together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import table
from churnlens.llm.vectors import Distinct, best_rows, finite, search_shards

K = 20
LEAF = 128
#: Measured recall at 20 and share of computed distances: see the README.
FACTOR = 5.0
_SPARE = 8  # places beyond k + 1, since block products round in the last bits


class VPTree:
    """Nodes in arrays: vantage vector, distance ranges of the two sides,
    children (negative: leaf number) over vectors in leaf order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.order = np.arange(len(x))
        norms = (x * x).sum(axis=1)
        self.top = float(norms.max())
        lifted = np.column_stack([x, np.sqrt(np.maximum(self.top - norms, 0))])
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[int, float, tuple, tuple, int, int]] = []
        self.leaves: list[tuple[int, int]] = []
        self.root = self._split(lifted, 0, len(x), leaf, rng)
        self.x = x[self.order]

    def _split(self, lifted, lo, hi, leaf, rng) -> int:
        own = self.order[lo:hi]
        if hi - lo > leaf:
            tries = rng.choice(own, min(4, len(own)), replace=False)
            probe = lifted[rng.choice(own, min(64, len(own)), replace=False)]
            spread = [np.sqrt(((probe - lifted[t]) ** 2).sum(axis=1)).std() for t in tries]
            vantage = int(tries[int(np.argmax(spread))])
            d = np.sqrt(((lifted[own] - lifted[vantage]) ** 2).sum(axis=1))
            if d.max() > 0:
                by = np.argsort(d, kind="stable")
                self.order[lo:hi], d = own[by], d[by]
                half = (hi - lo) // 2
                at = len(self.nodes)
                self.nodes.append(())
                inner = self._split(lifted, lo, lo + half, leaf, rng)
                outer = self._split(lifted, lo + half, hi, leaf, rng)
                self.nodes[at] = (vantage, float(d[half]), (float(d[0]), float(d[half - 1])),
                                  (float(d[half]), float(d[-1])), inner, outer)
                return at
        self.leaves.append((lo, hi))
        return -len(self.leaves)


class ShardIndex:
    """One shard's distinct vectors and their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.rows = Distinct(ids, x, k)
        self.tree = VPTree(self.rows.x)
        self.rows.x = self.rows.x.astype(np.float64)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        """Yields (query number, ids, scores) of each query's k nearest found."""
        tree, keep = self.tree, k + 1 + _SPARE
        norms = (q * q).sum(axis=1) + tree.top
        best = np.full((len(q), keep), -np.inf)
        vector = np.full((len(q), keep), -1)
        self.computed = 0

        def reach(who):  # distance to the k-th best
            return np.sqrt(np.maximum(norms[who] - 2 * best[who, k], 0))

        def scan(leaf, who):
            lo, hi = tree.leaves[-leaf - 1]
            score = q[who] @ tree.x[lo:hi].T
            self.computed += score.size
            score[self.rows.own(tree.order[lo:hi], query_ids[who])] = -np.inf
            both = np.concatenate([best[who], score], axis=1)
            ids = np.concatenate([vector[who], np.broadcast_to(tree.order[lo:hi], score.shape)], axis=1)
            top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            got = np.take_along_axis(both, top, 1)
            by = np.argsort(-got, axis=1, kind="stable")
            best[who] = np.take_along_axis(got, by, 1)
            vector[who] = np.take_along_axis(np.take_along_axis(ids, top, 1), by, 1)

        def visit(node, who):
            if not len(who):
                return
            if node < 0:
                scan(node, who)
                return
            vantage, middle, inside, outside, inner, outer = tree.nodes[node]
            d = np.sqrt(np.maximum(norms[who] - 2 * (q[who] @ self.rows.x[vantage]), 0))
            self.computed += len(who)
            near = d < middle
            visit(inner, who[near])
            visit(outer, who[~near])
            for side, limits, late in ((outer, outside, near), (inner, inside, ~near)):
                rest, dist = who[late], d[late]
                least = np.maximum(np.maximum(limits[0] - dist, dist - limits[1]), 0)
                visit(side, rest[least * factor <= reach(rest) * (1 + 1e-9) + 1e-9])

        visit(tree.root, np.arange(len(q)))
        for i in range(len(q)):
            v = vector[i][vector[i] >= 0]
            exact = (self.rows.x[v] * q[i]).sum(axis=1)
            ids, scores = best_rows(*self.rows.expand(v, exact), query_ids[i], k)
            yield i, ids, scores


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR,
                       id_col: str = "vec_id", vector: str = "embedding", **sizes) -> DataFrame:
    """Each query's ``k`` nearest rows but its own: query_id, rank, vec_id,
    score.  Null, zero, empty and non-finite vectors and null ids take no
    part; an empty table gives no rows; equal scores go to the smaller id;
    of a repeated query id the least vector asks, and no row of that id is
    its candidate."""
    usable = finite(vector) & F.exists(F.col(vector), lambda x: x != 0)
    return search_shards(
        rows.filter(usable), queries.filter(usable), id_col, vector, k,
        lambda ids, x: ShardIndex(ids, x, k),
        lambda index, ids, q: index.search(ids, q, k, factor), "double", **sizes)


def op4_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.filter("vec_id % 20 = 0"))
