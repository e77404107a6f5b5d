"""Exact top-k search (largest integer inner product) by M-trees.

Vectors are integers.  In a shard they get one more component so that all
have the length of the longest; the Euclidean distance to a query then falls
as the inner product grows.  An M-tree's pages hold routing vectors with
covering radii and distances to the page's own routing vector.  Every query
takes leaf pages best first, by the greatest score that their radii allow,
and stops where that is below its k-th best score.  The queries of a block go
in rounds: those whose next page is the same evaluate it together, as one
product of matrices over the page's contiguous rows, without the entries
whose distances to the routing vector already show, by the triangle
inequality, that they are too far for all of them.  Scores are exact
integers, bounds get a slack far above their rounding, and entries at the
k-th score are still looked at, so ties go to the smaller id.
"""

from __future__ import annotations

import sys
from operator import mul

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import table
from churnlens.llm.vectors import Distinct, finite, search_shards

K = 20
SCALE = 64
PAGE = 256
FANOUT = 48
#: Vectors of a smaller squared length have exact inner products in doubles:
#: no partial sum passes the product of two lengths.
EXACT = float(1 << 53)


def long_vectors(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(axis=-1) >= EXACT


class Whole:
    """Exact search of distinct vectors of any length."""

    def __init__(self, rows: Distinct):
        self.rows = rows
        self.shift = int(np.frexp(np.abs(rows.x).max())[1])
        self.near = np.ldexp(rows.x, -self.shift)  # at most 1
        self.length = np.sqrt((self.near * self.near).sum(axis=1))

    def best(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of rows that hold the k best other rows."""
        rows = self.rows
        unit = np.ldexp(q, -int(np.frexp(np.abs(q).max())[1]))
        about = self.near @ unit
        # rounding of products and sums, and of what ldexp brought below the least double
        error = len(q) * 2.0 ** -50 * self.length * np.sqrt(unit @ unit) + len(q) * 1e-300
        open_ = np.flatnonzero(~rows.own(slice(None), np.array([own]))[0])
        if len(open_) > k:
            floor = np.partition((about - error)[open_], -k)[-k]
            open_ = open_[(about + error)[open_] >= floor]
        whole_q = [int(c) for c in q]
        scores = np.empty(len(open_), object)
        scores[:] = [sum(map(mul, map(int, rows.x[v]), whole_q)) for v in open_]
        ids, scores = rows.expand(open_, scores)
        return [(s, int(i)) for i, s in zip(ids, scores) if i != own]


class MTree:
    """Pages in lists; every page has a routing vector.

    An inner page ``(False, routing vectors of its children, covering radii,
    radii without the added component, child pages)``, a leaf page ``(True,
    routing vector, leaf number)``; a leaf's entries are in order of their
    distance to its routing vector.
    """

    def __init__(self, x: np.ndarray, page: int = PAGE, fanout: int = FANOUT, seed: int = 5):
        norms = (x * x).sum(axis=1)
        self.x, self.top = x, float(norms.max())
        self.leaves: list[tuple] = []  # (rows, their vectors, distances to the routing vector)
        self.lifted = np.column_stack([x, np.sqrt(np.maximum(self.top - norms, 0))])
        self.pages: list[tuple] = []
        rng = np.random.default_rng(seed)
        everything = np.arange(len(x))
        self.root_vector = int(rng.integers(len(x)))
        self.root = self._build(everything, self.root_vector, page, fanout, rng)
        del self.lifted

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.lifted[rows] - self.lifted[centre]) ** 2).sum(axis=1))

    def _build(self, rows, centre, page, fanout, rng) -> int:
        own = self._distance(rows, centre)
        groups = self._deal(rows, fanout, rng) if len(rows) > page and own.max() > 0 else []
        if len(groups) < 2:
            # all alike (or few): one leaf, nearest to the routing vector first
            by = np.argsort(own, kind="stable")
            self.leaves.append((rows[by], np.ascontiguousarray(self.x[rows[by]]), own[by]))
            self.pages.append((True, centre, len(self.leaves) - 1))
            return len(self.pages) - 1
        centres = np.array([c for c, _ in groups])
        radii = np.array([self._distance(g, c).max() for c, g in groups])
        children = [self._build(g, c, page, fanout, rng) for c, g in groups]
        flat = np.array([np.sqrt(((self.x[g] - self.x[c]) ** 2).sum(axis=1).max()) for c, g in groups])
        self.pages.append((False, centres, radii, flat, np.array(children)))
        return len(self.pages) - 1

    def reach(self, q: np.ndarray):
        """For every query and leaf page: the leaves, the greatest score
        their covering radii allow, and the distance to the page's routing
        vector; and the squared lengths that turn scores into distances."""
        norms = (q * q).sum(axis=1) + self.top
        length = np.sqrt((q * q).sum(axis=1))
        pages, bounds, parents = [], [], []
        todo = [(self.root, np.full(len(q), np.inf), None)]
        while todo:
            page, above, d = todo.pop()
            if self.pages[page][0]:
                _, centre, leaf = self.pages[page]
                if d is None:
                    d = np.sqrt(np.maximum(norms - 2 * (q @ self.x[centre]), 0))
                pages.append(leaf)
                bounds.append(above)
                parents.append(d)
                continue
            _, centres, radii, flat, children = self.pages[page]
            score = q @ self.x[centres].T
            far = np.sqrt(np.maximum(norms[:, None] - 2 * score, 0))
            least = np.maximum(far - radii, 0)  # least distance to any entry below
            most = np.minimum((norms[:, None] - least * least) / 2, score + length[:, None] * flat)
            for j, child in enumerate(children):
                todo.append((int(child), np.minimum(above, most[:, j]), far[:, j]))
        return np.array(pages), np.column_stack(bounds), np.column_stack(parents), norms

    def _deal(self, rows, fanout, rng):
        """Routing vectors far from each other, and the rows nearest to each."""
        pool = rng.choice(rows, min(len(rows), 32 * fanout), replace=False)
        centres = [int(pool[0])]
        least = self._distance(pool, centres[0])
        while len(centres) < fanout and least.max() > 0:
            centres.append(int(pool[int(np.argmax(least))]))
            least = np.minimum(least, self._distance(pool, centres[-1]))
        d = np.column_stack([self._distance(rows, c) for c in centres])
        mine = d.argmin(axis=1)
        return [(c, rows[mine == j]) for j, c in enumerate(centres) if (mine == j).any()]


class ShardIndex:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        far = long_vectors(x)
        self.far = Whole(Distinct(ids[far], x[far], k)) if far.any() else None
        self.rows = self.tree = None
        if not far.all():
            self.rows = Distinct(ids[~far], x[~far], k)
            self.tree = MTree(self.rows.x)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        """Yields (query number, ids, scores) of each query's k best rows;
        scores are longs, or Python integers where long vectors take part."""
        self.computed = 0
        far = long_vectors(q)
        near = Whole(self.rows) if self.rows is not None and far.any() else None
        short = np.flatnonzero(~far)
        tree = {}
        if self.rows is not None and len(short):
            for j, ids, scores in self._many(query_ids[short], q[short], k):
                if self.far is None:
                    yield int(short[j]), ids, scores.astype(np.int64)
                else:
                    tree[int(short[j])] = list(zip(map(int, scores), map(int, ids)))
        for i in range(len(q)):
            own, got = int(query_ids[i]), tree.get(i, [])
            if not far[i]:
                if self.far is None:
                    continue
            elif near is not None:
                got = near.best(own, q[i], k)
            if self.far is not None:
                got += self.far.best(own, q[i], k)
            got = sorted(got, key=lambda r: (-r[0], r[1]))[:k]
            scores = np.empty(len(got), object)
            scores[:] = [s for s, _ in got]
            yield i, np.array([j for _, j in got], np.int64), scores

    def _many(self, own: np.ndarray, q: np.ndarray, k: int):
        """(query number, ids, scores) of the k best rows of every query."""
        tree = self.tree
        pages, bound, parent, norms = tree.reach(q)
        self.computed += bound.size
        slack = 1e-9 * (1 + norms)
        order = np.argsort(-bound, axis=1, kind="stable")
        limit = np.full(len(q), -np.inf)  # the k-th best score so far
        top = np.full((len(q), k), -np.inf)
        hits: list[tuple] = []
        open_ = np.arange(len(q))
        for turn in range(len(pages)):
            page = order[open_, turn]
            going = bound[open_, page] + slack[open_] >= limit[open_]  # best first: the others are done
            open_, page = open_[going], page[going]
            by = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], page[by][1:] != page[by][:-1]])) if len(by) else []
            for who in np.split(open_[by], cuts[1:]) if len(by) else []:
                number = order[who[0], turn]
                rows, x, apart = tree.leaves[pages[number]]
                # |d(query, routing) - d(entry, routing)| is a least distance
                far = np.sqrt(np.maximum(norms[who] - 2 * (limit[who] - slack[who]), 0))
                lo = np.searchsorted(apart, (parent[who, number] - far).min())
                hi = np.searchsorted(apart, (parent[who, number] + far).max(), side="right")
                if lo >= hi:
                    continue
                score = q[who] @ x[lo:hi].T
                self.computed += score.size
                score[self.rows.own(rows[lo:hi], own[who])] = -np.inf
                new = np.flatnonzero((score >= limit[who, None]).any(axis=1))
                if not len(new):
                    continue
                who, score = who[new], score[new]
                best = np.concatenate([top[who], score], axis=1)
                top[who] = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
                limit[who] = top[who].min(axis=1)
                at, col = np.nonzero((score >= limit[who, None]) & (score > -np.inf))
                hits.append((who[at], rows[lo:hi][col], score[at, col]))
        if hits:
            who, vector, score = (np.concatenate(h) for h in zip(*hits))
            last = score >= limit[who]
            who, vector, score = who[last], vector[last], score[last]
            n = self.rows.start[vector + 1] - self.rows.start[vector]
            ids, score = self.rows.expand(vector, score)
            who = np.repeat(who, n)
            other = ids != own[who]
            who, ids, score = who[other], ids[other], score[other]
            by = np.lexsort((ids, -score, who))
            who, ids, score = who[by], ids[by], score[by]
            begin = np.searchsorted(who, np.arange(len(q) + 1))
            for i in range(len(q)):
                at = slice(begin[i], min(begin[i] + k, begin[i + 1]))
                yield i, ids[at], score[at]
        else:
            for i in range(len(q)):
                yield i, np.zeros(0, np.int64), np.zeros(0)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE,
          id_col: str = "vec_id", vector: str = "embedding", **sizes) -> DataFrame:
    """Each query's ``k`` rows of the largest inner product of
    floor(scale * component), but its own: query_id, rank, vec_id, score.

    Null, empty and non-finite vectors and null ids take no part; zero
    vectors do, and vectors of any finite size.  A score beyond a long is
    null, its rank exact.  Doubles that ``scale`` takes beyond a double are
    refused with an error (floats never are).  An empty table gives no rows.
    """
    def floor(x):
        # a double of 2**53 or more is whole already
        return (F.when(F.abs(x) < F.lit(float(1 << 53)) / scale, F.floor(x * scale).cast("double"))
                .when(F.abs(x) <= F.lit(sys.float_info.max) / scale, x * scale)
                .otherwise(F.raise_error(F.lit("a scaled component is beyond a double")).cast("double")))

    def whole(df):
        return df.filter(finite(vector)).select(
            id_col, F.transform(F.col(vector).cast("array<double>"), floor).alias(vector))

    return search_shards(whole(rows), whole(queries), id_col, vector, k,
                         lambda ids, x: ShardIndex(ids, x, k),
                         lambda index, ids, q: index.search(ids, q, k), "long", **sizes)


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))
